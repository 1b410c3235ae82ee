from pyspark.sql import functions as F

from argloom.llm import secrets


def test_every_row_is_learned_from(spark):
    """Of 45,000 rows with a word each, all words are counted."""
    docs = spark.range(45_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("ordinaire"), F.col("id") % 100).alias("text"))
    of = [r for r in secrets.labelled(docs).where("label = 0").collect() if r.word.startswith("ordinaire")]
    assert len(of) == 100 and sum(r.times for r in of) == 45_000


def test_threshold_is_the_order_statistic(spark):
    scores = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(997)) / 7.0).alias("s"), (F.col("id") % 3 + 1).alias("times")).cache()
    flat = sorted(s for s, t in scores.collect() for _ in range(t))
    for share in (0.0, 0.001, 0.25):
        want = min(x for x in set(flat) if sum(y > x for y in flat) <= share * len(flat))
        assert secrets.exceeded(scores, share) == want
    assert secrets.exceeded(scores.limit(0), 0.1) == 0.0
