import time

from pyspark.sql import functions as F

from argloom.operators import scope


def test_mentions_of_one_document_do_not_meet_all_its_options(spark):
    """40,000 mentions and as many options share three words each: 1.6 billion pairs, 4.8 billion common words."""
    n, each = 40_000, F.concat(F.lit("grand dépôt central num"), F.col("id").cast("string"))
    mentions = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("mention_no"), each.alias("mention"))
    options = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("seg_no"), each.alias("seg_text"))
    began = time.time()
    assert scope.mentioned_options(mentions, options).where("mention_no = seg_no").count() == n
    assert time.time() - began < 90


def test_long_mentions_and_options_as_by_all_pairs(spark):
    words = [f"mot{k}" for k in range(14)]
    texts = [" ".join(words[a:b]) for a in range(0, 12, 3) for b in range(a + 1, 15, 2)]
    said = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id int, mention_no int, mention string")
    offered = spark.createDataFrame([(1, k, t) for k, t in enumerate(reversed(texts[::2]))], "doc_id int, seg_no int, seg_text string")
    want = {}
    for k, t in enumerate(texts):
        found = [(-len({*t.split()} & {*o.split()}), len(o), j) for j, o in enumerate(reversed(texts[::2]))]
        want[k] = min(x for x in found if -x[0] >= 0.5 * len(t.split())) if any(-x[0] >= 0.5 * len(t.split()) for x in found) else None
    got = {r.mention_no: r.seg_no for r in scope.mentioned_options(said, offered).collect()}
    assert got == {k: x[2] for k, x in want.items() if x}
