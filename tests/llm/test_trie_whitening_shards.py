import glob
import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from argloom.llm import conversation_trie, kd_shards, whitening
from argloom.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op13_sharding"])
def test_against_sql(spark, duck, name):
    got, want = q.QUERIES[name](spark, SF), duck.sql(q.ORACLE_SQL[name])
    order = sorted(got.columns)
    rows = lambda found, columns: sorted((tuple(r[columns.index(c)] for c in order) for r in found), key=repr)
    assert order == sorted(want.columns) and rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


# --- op11


def nodes_of(convs):
    """Nodes of {conv: [(role, text), ...]} by walking every prefix."""
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    out = set()
    for p, m in members.items():
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below[p] if x)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[x] for x in below[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt_of(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def found(df):
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as depth", "3 as path", "4 as a", "5 as conv")


def test_trie_of_random_conversations(spark, monkeypatch):
    draw = random.Random(3)
    monkeypatch.setattr(conversation_trie, "BLOCK", 3)  # runs over several blocks
    monkeypatch.setattr(conversation_trie, "IDS", 2)
    convs = {c: [(draw.choice("ua"), draw.choice(["", "x", "yy", "é\U0001f600z"])) for _ in range(draw.randint(1, 9))] for c in draw.sample(range(0, 420), 150)}
    rows = [(c, t, *x) for c, turns in convs.items() for t, x in enumerate(turns)]
    draw.shuffle(rows)
    assert found(conversation_trie.family_trie(table(spark, rows))) == nodes_of(rebuilt_of(convs))
    assert found(conversation_trie.prefix_trie(table(spark, rows))) == nodes_of(convs)


def test_trie_of_beginnings_of_one_another(spark, monkeypatch):
    """A caterpillar: every conversation goes on where the one before ends; rounds grow with the logarithm of their number."""
    convs = {c: [("user", f"t{d}") for d in range(c)] for c in range(1, 61)}
    rounds = []
    monkeypatch.setattr(conversation_trie, "cut", lambda df, old=conversation_trie.cut: rounds.append(1) or old(df))
    got = found(conversation_trie.prefix_trie(table(spark, [(c, t, *x) for c, turns in convs.items() for t, x in enumerate(turns)])))
    assert got == nodes_of(convs) and len(rounds) < 25


def test_trie_of_hard_rows(spark):
    long = "w" * 1_200_000
    rows = [(7, None, None, None), (7, 0, "user", long), (7, 1, "user", ""), (None, 0, "user", "lost"), (8, 0, "", ""), (8, 1, "user", long), (9, 0, "", ""), (9, 0, "", ""), (-3, 5, "b", "y"), (-3, None, "a", "x")]
    convs = {7: [("", ""), ("user", long), ("user", "")], 8: [("", ""), ("user", long)], 9: [("", ""), ("", "")], -3: [("a", "x"), ("b", "y")]}
    assert found(conversation_trie.prefix_trie(table(spark, rows))) == nodes_of(convs)
    copies = table(spark, [(c, 0, "user", "same") for c in range(500)])
    assert found(conversation_trie.prefix_trie(copies)) == nodes_of({c: [("user", "same")] for c in range(500)})
    assert found(conversation_trie.family_trie(table(spark, []))) == set()
    alone = table(spark, [(1, 0, "user", "own")])  # its head is absent
    assert found(conversation_trie.family_trie(alone)) == nodes_of(rebuilt_of({1: [("user", "own")]}))


# --- op12


def whitened_of(vectors, components=4):
    x = np.floor(256 * np.array(vectors, dtype=float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = (fit - s / n).T @ (fit - s / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ u / np.sqrt(e), e / np.trace(v)


def check_whitened(rows, vectors, ids):
    n, deviation, white, explained = whitened_of(vectors)
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(ids) * white.shape[1] == len(by)
    got = np.array([[by[i, k + 1].whitened for k in range(white.shape[1])] for i in ids])
    sign = np.sign((got * white).sum(0))
    assert np.allclose(got, white * sign, atol=1e-9)
    assert all(by[i, 1].deviation == d and by[i, 1].n == n for i, d in zip(ids, deviation.tolist(), strict=True))
    assert all(np.isclose(by[ids[0], k + 1].explained, explained[k], rtol=1e-9) for k in range(white.shape[1])) and {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_op12_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitened(q.op12_embedding_whitening(spark, SF).collect(), [r.embedding for r in table], [r.vec_id for r in table])


def test_whitening_of_hard_rows(spark, monkeypatch):
    draw = np.random.default_rng(5)
    good = draw.normal(size=(60, 7)).round(2).tolist()
    good += [good[0]] * 300  # copies are fitted once
    bad = [None, [], [1.0, None] + [0.0] * 5, [float("nan")] * 7, [float("inf")] + [0.0] * 6, [1.0, 2.0]]
    schema = "vec_id long, embedding array<double>, x int, n int, component string"
    frame = spark.createDataFrame([(k, v, 1, 2, "c") for k, v in enumerate(good + bad)], schema)
    check_whitened(whitening.whiten(frame).collect(), good, list(range(len(good))))
    monkeypatch.setattr(whitening, "PANEL", 3)
    monkeypatch.setattr(whitening, "EXPRESSIONS", 10)  # the triangle in panels
    check_whitened(whitening.whiten(frame).collect(), good, list(range(len(good))))
    few = lambda vectors: whitening.whiten(spark.createDataFrame([(k, v, 1, 2, "c") for k, v in enumerate(vectors)], schema)).collect()
    assert few([]) == [] and few([[1.0, 2.0]] * 5) == [] and few([None, []]) == []
    flat = few([[float(k), 2.0 * k, 0.0] for k in range(5)])  # one direction only
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    assert len(few([[1e300, 0.0], [-1e300, 1.0], [0.0, 0.5]])) == 3  # the second is nothing beside the first


# --- op13


def shards_of(rows, shards):
    """The k-d tree by sorting every node's rows; rows are (n, size, (codes), k1, k2)."""
    spread = [max(r[2][d] for r in rows) - min(r[2][d] for r in rows) for d in range(len(rows[0][2]))]
    out = {}

    def split(node, k, first):
        if k == 1 or not node:
            out.update((r[0], first) for r in node)
            return
        wide = [(max(r[2][d] for r in node) - min(r[2][d] for r in node)) / w if w else 0 for d, w in enumerate(spread)]
        d = wide.index(max(wide))
        node = sorted(node, key=lambda r: (r[2][d], r[3], r[4], r[0]))
        want, upto, cut = sum(r[1] for r in node) * (k // 2) / k, 0, 0
        for at, r in enumerate(node):
            if 2 * upto + r[1] <= 2 * want:
                cut = at + 1
            upto += r[1]
        split(node[:cut], k // 2, first)
        split(node[cut:], k - k // 2, first + k // 2)

    split(rows, shards, 0)
    return out


@pytest.mark.parametrize("shards", [1, 7])
def test_tree_of_random_rows(spark, monkeypatch, shards):
    draw = random.Random(shards)
    monkeypatch.setattr(kd_shards, "BUCKETS", 16)
    monkeypatch.setattr(kd_shards, "FEW", 8)
    texts = ["hot text"] * 400 + ["x" * draw.randint(0, 90) for _ in range(500)]
    rows = [(None if k % 3 == 0 else draw.randint(0, 40), t, draw.choice(["https://a", "https://b/c", "https://b", None]), draw.choice([None, float("nan"), float("inf"), -1.5, 2.0, 3.25])) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    measured = kd_shards.measure(docs, ("source", "weight"))
    held = measured.collect()
    want = shards_of([(r.n, r.size, (r.c0, r.c1), r.k1, r.k2) for r in held], shards)
    placed = kd_shards.tree(measured, 2, shards)
    assert {r.n: r.shard for r in placed.collect()} == want
    slots = defaultdict(list)
    for r in kd_shards.numbered(placed, shards).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_codes_keep_the_order(spark):
    values = [None, "", "é", "z", "\U0001f600", "a", "ab", "abcdefgh", "abcdefgi"]
    rows = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "s string, k int")
    got = {r.s: r.c for r in rows.select("s", kd_shards.codes(rows, ("s",))[0].alias("c")).collect()}
    order = sorted([v for v in values if v is not None], key=lambda v: v.encode())
    assert got[None] == -1 and [got[v] for v in order] == sorted(got[v] for v in order) and got["a"] < got["ab"] < got["abcdefgh"] == got["abcdefgi"]


def test_shards_of_hard_rows(spark, hard_docs, monkeypatch):
    got = kd_shards.shard(hard_docs, shards=3).collect()
    assert len(got) == 11 and sum(r.size for r in got if r.doc_id in (3, 4)) == 2
    assert {r.text_crc32 for r in got if r.doc_id == 3} == {0}
    monkeypatch.setattr(kd_shards, "NUMBERED", 4)
    same = spark.createDataFrame([(1, "a b", "s", "l", 3)] * 1000, "doc_id long, text string, source string, lang string, n_chars long")
    rows = kd_shards.shard(same, shards=16).collect()
    counts = defaultdict(list)
    for r in rows:
        counts[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) and abs(len(v) - 62.5) <= 1 for v in counts.values()) and len(counts) == 16
    assert kd_shards.shard(same.where("false"), shards=16).collect() == []
    sized = kd_shards.shard(same, shards=None, target_bytes=500).collect()
    assert len({r.shard for r in sized}) == 8
