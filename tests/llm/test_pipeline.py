import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from argloom.llm import byte_bpe
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()} if k < 4 else None
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / str(k)))
        last, docs = docs, spark.read.parquet(path)
        after = docs.collect()
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS and all(before[r.doc_id] == r for r in after), name
        if k == 0:
            toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            gone = before.keys() - {r.doc_id for r in after}
            assert gone and sum(toxic.get(i, 1) for i in gone) >= 0.98 * len(gone) and len(after) == len(before) - len(gone)
        if k == 1:
            first = {}
            for i, r in sorted(before.items()):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), i)
            assert sorted(r.doc_id for r in after) == sorted(first.values())
        if k == 2:
            assert {r.doc_id for r in after} == {c for c, _ in brute([(i, r.text) for i, r in before.items()]).values()}
        if k == 3:
            times = Counter(r.doc_id for r in after)
            assert max(times.values()) <= 3 and times.keys() <= before.keys()
    ranks = byte_bpe.coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, hashlib.sha256(",".join(map(str, enc.encode_ordinary(r.text))).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in last.collect())
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in after) == want


def test_run_agrees_with_itself(spark):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert one == two and one

