"""Rankings that a model names, beside those the surface shows: their places, their sides and what "the others" are.

Replies of the stage ``preferences`` name groups of options by number or by mention. A row
counts if more than half of the ballots of its question hold it as it is, its marker
stands in a segment with a ranking that the surface did not settle, and both sides
resolve to options. "The others" are what a nearest containing set leaves: a set
preferred before, or an enumeration (see ``scope.complements``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argloom.functions.text import locate_span
from argloom.operators import answers, scope, vote
from argloom.session import cut

# Fixed value: most words of a marker.
LONGEST_MARKER = 5
#: Answered rows come after all that the surface shows.
AFTER = 1_000_000
FIELDS = ["marker_n", "marker", "preferred", "contrasted", "complement", "delta", "reactivates"]


def voted(replies: DataFrame) -> DataFrame:
    """doc_id, batch_no and the fields of the ranking rows that more than half of the ballots held give alike."""
    own = replies.where("stage = 'preferences'")
    held = own.groupBy("doc_id", "batch_no").agg(F.count_distinct("ballot_no").alias("ballots"))
    read = answers.rankings(own).select("doc_id", "batch_no", "ballot_no", F.struct(*FIELDS).alias("value"))
    return vote.majority_support(read, held, ["doc_id", "batch_no"]).select("doc_id", "batch_no", "value.*")


def placed(rows: DataFrame, cues: DataFrame) -> DataFrame:
    """rows (doc_id, row_no, marker_n, marker) with marker_n, marker_start and marker_end of the cue segment (doc_id, seg_no, start, seg_text) that holds the marker: the one it names, else the only one that holds it."""
    short = rows.where(F.size(F.split(F.trim("marker"), r"\s+")).between(1, LONGEST_MARKER) & (F.trim("marker") != ""))
    met = short.join(cues.select("doc_id", "seg_no", F.col("start").alias("seg_start"), "seg_text"), "doc_id").withColumn("at", locate_span(F.col("seg_text"), F.col("marker"), F.col("seg_start")))
    by_row = Window.partitionBy("doc_id", "row_no")
    named = F.max(F.coalesce(F.col("seg_no") == F.col("marker_n"), F.lit(False))).over(by_row)
    found = met.withColumn("named", named).where(F.when(F.col("named"), F.col("seg_no") == F.col("marker_n")).otherwise(F.lit(True)) & F.col("at").isNotNull())
    alone = found.withColumn("held", F.count("*").over(by_row)).where("held = 1")
    return alone.select("doc_id", "row_no", F.col("seg_no").alias("marker_n"), F.col("at.start").alias("marker_start"), F.col("at.end").alias("marker_end"))


def resolved(rows: DataFrame, side: str, keys: DataFrame, options: DataFrame) -> DataFrame:
    """doc_id, row_no and the side as numbers, in order, each once: numbers of entities (keys: doc_id, seg_no), else the options (doc_id, seg_no, seg_text) that mentions name."""
    each = rows.select("doc_id", "row_no", F.posexplode(side).alias("pos", "said")).withColumn("seg_no", F.col("said").try_cast("int"))
    number = each.join(keys.select("doc_id", "seg_no").distinct(), ["doc_id", "seg_no"]).select("doc_id", "row_no", "pos", "seg_no")
    words = each.where("seg_no IS NULL").withColumn("mention_no", F.struct("row_no", "pos"))
    named = scope.mentioned_options(words.select("doc_id", "mention_no", F.col("said").alias("mention")), options)
    both = number.unionByName(named.select("doc_id", F.col("mention_no.row_no").alias("row_no"), F.col("mention_no.pos").alias("pos"), "seg_no"))
    listed = both.groupBy("doc_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("pos", "seg_no"))).alias("all"))
    return listed.select("doc_id", "row_no", F.array_distinct(F.transform("all", lambda x: x["seg_no"])).alias(side))


def answered(features: DataFrame, key_rows: DataFrame, shown: DataFrame, scopes: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of rankings that replies add, and those whose "others" stay ambiguous (doc_id, marker_n).

    Rows: doc_id, row_no, marker_n, preferred, contrasted, delta, reactivates, marker_start,
    marker_end. shown: doc_id, row_no, marker_n, preferred of the surface's rankings. scopes:
    doc_id, members of enumerations and of options of one scenario.
    """
    open_ = features.where("ranking").join(shown.select("doc_id", F.col("marker_n").alias("seg_no")), ["doc_id", "seg_no"], "left_anti")
    order = Window.partitionBy("doc_id").orderBy("batch_no", "marker_n", F.to_json(F.struct(*FIELDS)))
    rows = cut(voted(replies).withColumn("row_no", F.lit(AFTER) + F.row_number().over(order)))
    options = key_rows.where("kind = 'Option'").select("doc_id", "seg_no").distinct().join(features.select("doc_id", "seg_no", "seg_text"), ["doc_id", "seg_no"])
    at = placed(rows.select("doc_id", "row_no", "marker_n", "marker"), open_)
    whole = rows.select("doc_id", "row_no", "complement", "delta", "reactivates").join(at, ["doc_id", "row_no"])
    whole = whole.join(resolved(rows, "preferred", key_rows, options), ["doc_id", "row_no"]).join(resolved(rows, "contrasted", key_rows, options), ["doc_id", "row_no"], "left")
    whole = cut(whole)
    sides = ["doc_id", "row_no", "marker_n", "preferred"]
    sets = shown.select(*sides).unionByName(whole.select(*sides)).withColumnRenamed("row_no", "pref_no")
    numbered = scopes.withColumn("scope_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("members")))
    others = scope.complements(sets, numbered, options, scope.blocks(features)).withColumnRenamed("pref_no", "row_no")
    told = whole.join(others, ["doc_id", "row_no"], "left").withColumn("contrasted", F.when(F.col("complement"), F.col("others")).otherwise(F.col("contrasted")))
    known = key_rows.groupBy("doc_id").agg(F.collect_set("seg_no").alias("known"))
    told = cut(told.join(known, "doc_id"))
    held = lambda c: F.array_distinct(F.array_intersect(c, "known")).alias(c)
    good = told.where("size(preferred) > 0 AND size(contrasted) > 0 AND NOT arrays_overlap(preferred, contrasted)")
    kept = good.select("doc_id", "row_no", "marker_n", "preferred", "contrasted", held("delta"), held("reactivates"), "marker_start", "marker_end")
    return kept, told.where("complement AND status = 'AMBIGUOUS'").select("doc_id", "marker_n").distinct()
