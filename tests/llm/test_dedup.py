import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from argloom.llm import exact_dedup, exchange, substring_dedup
from argloom.llm.queries import op1_substring_dedup, op5_exact_dedup

SF = "/root/testdata/sf0.001"


def brute_windows(texts, k):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        yield len(w), sum(gone), hashlib.sha256(kept).hexdigest()


def test_golomb_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        for high in (2**20, 2**63):
            v = np.unique(rnd.integers(0, high, n, dtype=np.uint64))
            assert (exchange.ungolomb(exchange.golomb(v)) == v).all()
    v = np.array([0, 2**64 - 1], np.uint64)
    assert (exchange.ungolomb(exchange.golomb(v)) == v).all()


def test_rolled_hashes_depend_on_the_window_alone():
    h = np.random.default_rng(2).integers(0, 2**63, 200, dtype=np.uint64)
    h[100:140] = h[10:50]
    for k in (1, 2, 3, 18, 35):
        r = substring_dedup.rolled(h, k, substring_dedup.ODD[0])
        assert len(r) == 201 - k and r[100] == r[10] and len(set(r.tolist())) == len(r) - (41 - k)


@pytest.mark.parametrize("k", [5, 35])
def test_substrings_against_brute_force(spark, k):
    rnd = random.Random(k)
    passages = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(k - 2, 3 * k))] for _ in range(6)]
    texts = []
    for i in range(80):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += [f"u{rnd.randint(0, 9999)}" for _ in range(rnd.randint(0, 2 * k))] + (p := rnd.choice(passages))[: rnd.randint(k - 2, len(p))]
        texts.append(" ".join(w))
    texts += ["same " * 120, "a b " * 90, None, "", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df, k).collect()}
    assert got == dict(enumerate(brute_windows(texts, k)))


def test_op1_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, SF).collect()}
    assert got == dict(zip([r.doc_id for r in rows], brute_windows([r.text for r in rows], 35)))
    assert sum(v[1] for v in got.values()) > 0


def test_substrings_of_hard_rows(spark, hard_docs):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(hard_docs, 35).collect())
    rows = hard_docs.collect()
    assert got == sorted((str(r.doc_id), *b) for r, b in zip(rows, brute_windows([r.text for r in rows], 35)))
    assert substring_dedup.remove_repeats(hard_docs.limit(0), 35).count() == 0


def brute_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[b" ".join(([b""] if (t or "")[:1].strip(" \t\n\r\v\f") == "" and t else []) + (t or "").encode().split() + ([b""] if t and t[-1] in " \t\n\r\v\f" and t.encode().split() else []))].append(i)
    return by


def test_op5_whole_table(spark):
    got = op5_exact_dedup(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = defaultdict(list)
    import re

    for i, t in texts.items():
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
    assert len(got) == len(texts) and any(len(g) > 1 for g in by.values())


def test_exact_dedup_of_hard_rows(spark, hard_docs):
    got = exact_dedup.groups(hard_docs).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in got) == sorted([
        ("1", 1, 4, True), ("2", 1, 4, False), ("2", 1, 4, False), ("None", 1, 4, False), ("3", 3, 2, True), ("4", 3, 2, False),
        ("5", 5, 1, True), ("6", 6, 1, True), ("7", 7, 1, True), ("8", 8, 1, True), ("9", 9, 1, True),
    ])
    twice = hard_docs.where("doc_id = 2")
    assert sorted(r.kept for r in exact_dedup.groups(twice).collect()) == [False, True]
    assert exact_dedup.dedup(twice).columns == hard_docs.columns and exact_dedup.dedup(hard_docs).count() == 7
    assert exact_dedup.groups(hard_docs.limit(0)).count() == 0
