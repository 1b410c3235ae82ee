"""Answers of a model to closed questions, as a table; nothing is called from here.

Replies: doc_id, batch_no, ballot_no, payload (text with a JSON object in it, perhaps
after thoughts and in code fences). Each reader gives one row per usable entry; what
cannot be read gives none, so that votes and missing numbers are seen downstream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.functions.text import json_payload, truthy

KEYS = ("doc_id", "batch_no", "ballot_no")
# Answers to pair questions, and words that stand for all others.
RELATIONS = ["A_TO_B", "B_TO_A", "NONE", "AMBIGUOUS"]
OTHERS = r"(?i)^\s*COMPLEMENT\s*$|\b(?:autres?|others?|remaining|restants?|reste)\b"


def _entries(replies: DataFrame, stage: str, fields: str, *more: str) -> DataFrame:
    read = F.from_json(json_payload(F.col("payload")), f"{stage} ARRAY<STRUCT<{fields}>>")
    return replies.select(*KEYS, *more, F.explode(read[stage]).alias("x")).where("x IS NOT NULL")


def _whole(values: Column) -> Column:
    """The whole numbers among texts."""
    return F.filter(F.transform(F.coalesce(values, F.expr("CAST(array() AS ARRAY<STRING>)")), lambda v: v.try_cast("int")), lambda v: v.isNotNull())


def labels(replies: DataFrame) -> DataFrame:
    """KEYS, item, tags: P (proposition) and M (marker) that were said of a segment, or N; a single letter in t is read too."""
    x = _entries(replies, "labels", "n: STRING, p: STRING, m: STRING, t: STRING")
    said = F.filter(F.array(F.when(truthy(F.col("x.p")), "P"), F.when(truthy(F.col("x.m")), "M")), lambda t: t.isNotNull())
    letter = F.upper(F.left(F.trim("x.t"), F.lit(1)))
    tags = F.when(F.col("x.p").isNotNull() | F.col("x.m").isNotNull(), F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("N")))).when(letter.isin("P", "M", "N"), F.array(letter))
    return x.select(*KEYS, F.col("x.n").try_cast("int").alias("item"), tags.alias("tags")).where("item IS NOT NULL AND tags IS NOT NULL")


def support(replies: DataFrame, *more: str) -> DataFrame:
    """KEYS, more columns of the replies, item (conclusion), grounds (segment numbers)."""
    x = _entries(replies, "support", "c: STRING, g: ARRAY<STRING>", *more)
    return x.select(*KEYS, *more, F.col("x.c").try_cast("int").alias("item"), _whole(F.col("x.g")).alias("grounds")).where("item IS NOT NULL")


def relations(replies: DataFrame) -> DataFrame:
    """KEYS, item (pair), value (one of RELATIONS)."""
    x = _entries(replies, "relations", "n: STRING, r: STRING").select(*KEYS, F.col("x.n").try_cast("int").alias("item"), F.upper(F.trim("x.r")).alias("value"))
    return x.where(F.col("item").isNotNull() & F.col("value").isin(RELATIONS))


def narratives(replies: DataFrame) -> DataFrame:
    """KEYS, item (pair), value (Y or N)."""
    x = _entries(replies, "narrative", "n: STRING, r: STRING").select(*KEYS, F.col("x.n").try_cast("int").alias("item"), F.upper(F.left(F.trim("x.r"), F.lit(1))).alias("value"))
    return x.where("item IS NOT NULL AND value IN ('Y', 'N')")


def enumerations(replies: DataFrame) -> DataFrame:
    """KEYS, item (segment), items (two or more)."""
    full = F.filter(F.transform("x.items", lambda m: F.trim(m)), lambda m: m != "")
    return _entries(replies, "enumerations", "n: STRING, items: ARRAY<STRING>").select(*KEYS, F.col("x.n").try_cast("int").alias("item"), full.alias("items")).where("item IS NOT NULL AND size(items) > 1")


def rankings(replies: DataFrame) -> DataFrame:
    """KEYS, marker_n, marker, preferred and contrasted (numbers or mentions, as text), complement, delta, reactivates."""
    x = _entries(replies, "preferences", "preferred: ARRAY<STRING>, contrasted: ARRAY<STRING>, complement: STRING, delta: ARRAY<STRING>, reactivates: ARRAY<STRING>, marker_n: STRING, marker: STRING")
    full = lambda c: F.filter(F.transform(F.coalesce(c, F.expr("CAST(array() AS ARRAY<STRING>)")), lambda v: F.trim(v)), lambda v: v != "")
    against = full(F.col("x.contrasted"))
    rows = x.select(
        *KEYS, F.col("x.marker_n").try_cast("int").alias("marker_n"), F.trim(F.coalesce("x.marker", F.lit(""))).alias("marker"), full(F.col("x.preferred")).alias("preferred"),
        F.filter(against, lambda v: ~v.rlike(OTHERS)).alias("contrasted"), (truthy(F.col("x.complement")) | F.exists(against, lambda v: v.rlike(OTHERS))).alias("complement"),
        _whole(F.col("x.delta")).alias("delta"), _whole(F.col("x.reactivates")).alias("reactivates"),
    )
    return rows.where("size(preferred) > 0 AND (size(contrasted) > 0 OR complement)")


def judged(pairs: DataFrame, said: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, premise, conclusion of pairs (doc_id, item, l, r) that were given a direction (said: doc_id, item, value) and found no narrative (told: value N; unanswered pairs are dropped)."""
    df = pairs.join(said.where("value IN ('A_TO_B', 'B_TO_A')").select("doc_id", "item", "value"), ["doc_id", "item"]).join(told.where("value = 'N'").select("doc_id", "item"), ["doc_id", "item"], "left_semi")
    ahead = F.col("value") == "A_TO_B"
    return df.select("doc_id", F.when(ahead, F.col("l")).otherwise(F.col("r")).alias("premise"), F.when(ahead, F.col("r")).otherwise(F.col("l")).alias("conclusion"))


def numbered(items: DataFrame, keys: tuple[str, ...], item: str = "seg_no", text: str = "seg_text") -> DataFrame:
    """keys and lines: a batch's items as "n. text", one a line, in order."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(item).alias("n"), F.col(text).alias("t"))))
    return items.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["t"])), "\n").alias("lines"))
