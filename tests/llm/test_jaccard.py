import random
from collections import Counter, defaultdict

import numpy as np

from argloom.llm import jaccard
from argloom.llm import queries as q


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = (t or "").encode().split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute(rows, threshold=0.8):
    """{row number: (class id, links)} of (id, text) rows."""
    sets = sets_of([t for _, t in rows])
    where = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            where[g].add(i)
    links = defaultdict(set)
    for i, s in enumerate(sets):
        for j, c in Counter(j for g in s for j in where[g] if j > i).items():
            if c >= threshold * len(s | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    group, out = {}, {}
    for i in range(len(rows)):
        if i not in group:
            todo, seen = [i], {i}
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            group |= {x: min(rows[y][0] for y in seen) for x in seen}
        out[i] = group[i], len(links[i])
    return out


def near_copies(n=60, families=12):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(4))
    bases = [[word() for _ in range(rnd.randint(40, 300))] for _ in range(families)]
    texts = []
    for _ in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts + ["one two three", "one  two three", "one two", ""]


def check(got, rows):
    want = brute(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {rows[i][0]: v for i, v in want.items()}
    assert {r.doc_id for r in got if r.kept} == {v[0] for v in want.values()}


def test_against_brute_force(spark):
    rows = list(enumerate(near_copies()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(jaccard.join(df).collect(), rows)
    check(jaccard.join(df, cell=3).collect(), rows)  # components over many cells


def test_op8_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(q.op8_ngram_jaccard_join(spark, sf).collect(), rows)


def test_depth_and_recall():
    assert jaccard.depth_for(0.8, 20, 8, 0.999) == 5 and jaccard.depth_for(0.8, 20, 8, 0.5) == 8 and jaccard.depth_for(0.8, 2, 8, 0.999) == 1


def test_compare_against_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    got = jaccard.compare(sets, 0.5)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == (i != j and len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) - 1e-9)


def test_hard_rows(spark, hard_docs):
    got = Counter((r.doc_id, r.class_id, r.n_links, r.kept) for r in jaccard.join(hard_docs).collect())
    assert got == Counter([
        (1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False), (None, 1, 3, False), (3, 3, 0, True), (4, 4, 0, True),
        (5, 5, 1, True), (6, 5, 1, False), (7, 7, 0, True), (8, 8, 0, True), (9, 9, 0, True),
    ])
    assert jaccard.join(hard_docs.limit(0)).count() == 0
    assert jaccard.dedup(hard_docs).columns == hard_docs.columns
    assert sorted(r.doc_id for r in jaccard.dedup(hard_docs).collect()) == [1, 3, 4, 5, 7, 8, 9]
    same_id = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in jaccard.dedup(same_id).collect()) == [(1, "a b c d e"), (1, "v w x y z")]


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(60)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_large_crowds_are_dealt_with_less_than_the_square(spark, monkeypatch):
    """All of a crowd are linked; with four times its rows, the rows dealt to cells grow eightfold at most, and every link is counted once."""
    dealt, real = [], jaccard.map_arrow

    def counted(df, run, schema):
        if "block" in df.columns and "t" not in df.columns:
            dealt.append(df.count())
        return real(df, run, schema)

    monkeypatch.setattr(jaccard, "map_arrow", counted)
    base = " ".join(f"w{i}" for i in range(60))
    for n in (80, 320):
        rows = [(i, f"{base} end{i}") for i in range(n)]
        got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), cell=16).collect()
        assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, 0, n - 1) for i in range(n)}
    assert dealt[1] <= 8 * dealt[0]


def test_places_have_every_pair_once():
    for sizes in ([1, 700, 2], [jaccard.TILE, jaccard.TILE + 1, 3], [50] * 20, []):
        trie = object.__new__(jaccard.Subtrees)
        trie.cell = np.repeat(np.arange(len(sizes)), np.array(sizes, int))
        parts = [np.stack([a, b]) for a, b in trie.places()]
        assert all(p.shape[1] <= jaccard.PAIRS for p in parts)
        a, b = np.concatenate([np.zeros((2, 0), int), *parts], axis=1)
        assert (a < b).all() and (trie.cell[a] == trie.cell[b]).all()
        assert len(a) == len(set(zip(a.tolist(), b.tolist()))) == sum(s * (s - 1) // 2 for s in sizes)
