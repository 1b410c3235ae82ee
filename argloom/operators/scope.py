"""Mentions, enumerations and the scope of a complement: what ties the words of a ranking or an answer to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.functions.text import content_words, occurrences

#: Words of mentions and options that meet by sets of words, of which there are two to that power.
SHORT = 8
SPANS = "CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)"


def mentioned_options(mentions: DataFrame, options: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, mention_no, seg_no: the option that shares most content words with a mention, if that is half of the mention's or more.

    mentions: doc_id, mention_no, mention; options: doc_id, seg_no, seg_text. Of equal
    shares the shorter option counts, then the earlier. A mention and an option of at
    most SHORT words meet in a set of words that both have: of all options with a set
    only the one that would win is kept, so the work is the sets of each row and not the
    pairs. Longer ones meet word by word in an equi-join.
    """
    said = mentions.select("doc_id", "mention_no", content_words(F.col("mention")).alias("words")).withColumn("n", F.size("words"))
    offered = options.select("doc_id", "seg_no", F.length("seg_text").alias("long"), content_words(F.col("seg_text")).alias("words"))
    short = F.size("words") <= SHORT
    # by sets: the largest set of a mention that an option has is all that they share
    best = offered.where(short).select("doc_id", F.struct("long", "seg_no").alias("option"), F.explode(_sets(F.col("words"))).alias("set")).groupBy("doc_id", "set").agg(F.min("option").alias("option"))
    sets = F.filter(_sets(F.col("words")), lambda x: F.size(x) >= least * F.col("n"))
    by_set = said.where(short).select("doc_id", "mention_no", F.explode(sets).alias("set")).join(best.hint("merge"), ["doc_id", "set"])
    by_set = by_set.select("doc_id", "mention_no", F.size("set").cast("long").alias("common"), "option.long", "option.seg_no")
    # word by word: what is longer, on either side
    word = lambda df, *more: df.select("doc_id", *more, F.explode("words").alias("word"))
    met = lambda a, b: word(a, "mention_no", "n").join(word(b, "seg_no", "long").hint("merge"), ["doc_id", "word"])
    pairs = met(said.where(~short), offered).unionByName(met(said.where(short), offered.where(~short)))
    counted = pairs.groupBy("doc_id", "mention_no", "n", "seg_no", "long").agg(F.count("*").alias("common")).where(F.col("common") >= least * F.col("n"))
    shared = by_set.unionByName(counted.select("doc_id", "mention_no", "common", "long", "seg_no"))
    return shared.groupBy("doc_id", "mention_no").agg(F.min_by("seg_no", F.struct(-F.col("common"), F.col("long"), F.col("seg_no"))).alias("seg_no"))


def _sets(words: Column) -> Column:
    """All sets of one or more of distinct words, each sorted."""
    none = F.expr("CAST(array() AS ARRAY<ARRAY<STRING>>)")
    add = lambda a, w: F.concat(a, F.transform(a, lambda x: F.array_append(x, w)), F.array(F.array(w)))
    return F.aggregate(F.array_sort(words), none, add)


def nearby(targets: DataFrame, others: DataFrame, reach: int = 12) -> DataFrame:
    """doc_id, target, seg_no: segments of others within reach of a target, by an equi-join on buckets of numbers."""
    bucket = F.floor(F.col("seg_no") / reach)
    a = targets.select("doc_id", F.col("seg_no").alias("target"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    return a.join(others.select("doc_id", "seg_no", bucket.alias("bucket")), ["doc_id", "bucket"]).where(F.abs(F.col("seg_no") - F.col("target")) <= reach).select("doc_id", "target", "seg_no").distinct()


def blocks(segments: DataFrame) -> DataFrame:
    """doc_id, seg_no, block: the number of runs of line breaks before a segment, by running counts over gaps and segments, so no row looks at the whole text."""
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    breaks = lambda c: F.regexp_count(c, F.lit(r"\n+"))
    inside = F.coalesce(F.sum(breaks("seg_text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.select("doc_id", "seg_no", (F.sum(breaks("gap")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + inside).cast("int").alias("block"))


def exploded(segments: DataFrame, enumerations: DataFrame) -> DataFrame:
    """doc_id, seg_no (from 1 again), start, end, old_no, scope (old_no of an enumeration whose items the segments are, else null).

    enumerations: doc_id, seg_no, items. A segment falls into its items only if there
    are two or more and all are found in it, each after the one before (as they are, or
    folded); otherwise it stays as it is.
    """
    whole = F.filter(F.transform("items", lambda m: F.trim(m)), lambda m: m != "")
    items = F.when(F.size("items") > 1, F.col("items"))

    def place(a: Column, m: Column) -> Column:
        at = F.get(occurrences(F.substr("seg_text", a["at"] + 1), m), F.lit(0))
        begin, end = (a["at"] + at["start"]).cast("int"), (a["at"] + at["end"]).cast("int")
        found = F.struct(end.alias("at"), F.array_append(a["out"], F.struct(begin.alias("start"), end.alias("end"))).alias("out"))
        return F.when(at.isNull(), a).otherwise(found)

    df = segments.select("doc_id", "seg_no", "start", "end", "seg_text").join(enumerations.select("doc_id", "seg_no", whole.alias("items")), ["doc_id", "seg_no"], "left")
    df = df.withColumn("found", F.aggregate(items, F.struct(F.lit(0).alias("at"), F.expr(SPANS).alias("out")), place, lambda a: a["out"]))
    all_found = F.coalesce(F.size("found") == F.size("items"), F.lit(False))
    own = F.array(F.struct(F.lit(0).alias("start"), (F.col("end") - F.col("start")).cast("int").alias("end")))
    parts = df.select("doc_id", "seg_no", F.col("start").alias("base"), all_found.alias("split"), F.posexplode(F.when(all_found, F.col("found")).otherwise(own)).alias("pos", "span"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg_no", "pos"))
    return parts.select("doc_id", number.alias("seg_no"), (F.col("base") + F.col("span.start")).alias("start"), (F.col("base") + F.col("span.end")).alias("end"), F.col("seg_no").alias("old_no"), F.when(F.col("split"), F.col("seg_no")).alias("scope"))


def listed(segments: DataFrame, enumerations: DataFrame) -> DataFrame:
    """segments with enumerations (doc_id, seg_no, items) exploded, numbered again, gaps and marks before them worked out anew, and ``scope`` (see ``exploded``)."""
    old = segments.select(*[F.col(c).alias(f"old_{c}" if c in ("seg_no", "start", "end", "seg_text", "gap") else c) for c in segments.columns]).withColumnRenamed("old_seg_no", "old_no").drop("prefix_end")
    rows = exploded(segments, enumerations).join(old, ["doc_id", "old_no"])
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    rows = rows.withColumn("seg_text", F.substr("old_seg_text", F.col("start") - F.col("old_start") + 1, F.col("end") - F.col("start")))
    rows = rows.withColumns({"last_end": F.lag("end").over(w), "last_no": F.lag("old_no").over(w), "last_text": F.lag("seg_text").over(w)})
    left = F.lag(F.substr("old_seg_text", F.col("end") - F.col("old_start") + 1)).over(w)  # what an item leaves of its segment
    same = F.coalesce(F.col("last_no") == F.col("old_no"), F.lit(False))
    opened = F.concat(F.coalesce(left, F.lit("")), "old_gap", F.substr("old_seg_text", F.lit(1), F.col("start") - F.col("old_start")))
    rows = rows.withColumn("gap", F.when(same, F.substr("old_seg_text", F.col("last_end") - F.col("old_start") + 1, F.col("start") - F.col("last_end"))).otherwise(opened))
    bare = F.rtrim("gap", F.lit(" \t\r\n"))
    rows = rows.withColumn("prefix_end", F.when(bare != "", F.right(bare, F.lit(1))).otherwise(F.coalesce(F.right("last_text", F.lit(1)), F.lit(""))))
    return rows.select(*segments.columns, "scope")


def complements(preferences: DataFrame, scopes: DataFrame, options: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, pref_no, others (sorted options), status (RESOLVED or AMBIGUOUS): what a preferred set is preferred to, when the text says "the others".

    preferences: doc_id, pref_no, marker_n, preferred; scopes (enumerations): doc_id,
    scope_no, members; options: doc_id, seg_no; blocks: doc_id, seg_no, block. A parent
    is a strict superset in the same block before the marker: an earlier preferred set
    or an enumeration, nearest first, sets before enumerations at one distance. None,
    or two different ones at the least distance, is ambiguous. A set meets only those
    that hold its first option, by an index of members.
    """
    at = lambda df, number: df.join(blocks.select("doc_id", F.col("seg_no").alias(number), "block"), ["doc_id", number])
    targets = preferences.select("doc_id", "pref_no", "marker_n", F.array_sort(F.array_distinct("preferred")).alias("preferred"))
    placed = at(targets, "marker_n")
    sets = placed.select("doc_id", "block", F.col("marker_n").alias("place"), F.lit(0).alias("kind"), F.col("pref_no").alias("no"), F.col("preferred").alias("members"))
    lists = at(scopes.select("doc_id", "scope_no", "members", F.array_max("members").alias("place")), "place").select("doc_id", "block", "place", F.lit(1).alias("kind"), F.col("scope_no").alias("no"), "members")
    # members that are options, by each of them the whole set
    index = sets.unionByName(lists).withColumn("set_no", F.struct("kind", "no")).select("*", F.explode(F.array_distinct("members")).alias("seg_no")).drop("members").join(options.select("doc_id", "seg_no").distinct(), ["doc_id", "seg_no"])
    parents = index.groupBy("doc_id", "block", "place", "kind", "no").agg(F.sort_array(F.collect_list("seg_no")).alias("parent"))
    by_member = parents.select("*", F.explode("parent").alias("first"))
    wider = (F.size(F.array_except("preferred", "parent")) == 0) & (F.size("parent") > F.size("preferred"))
    before = (F.col("place") < F.col("marker_n")) & ((F.col("kind") == 1) | (F.col("no") < F.col("pref_no")))
    found = placed.withColumn("first", F.get("preferred", F.lit(0))).join(by_member, ["doc_id", "block", "first"]).where(wider & before)
    ranked = found.groupBy("doc_id", "pref_no").agg(F.sort_array(F.collect_list(F.struct((F.col("marker_n") - F.col("place")).alias("far"), "kind", (-F.col("no")).alias("late"), "parent"))).alias("all"))
    best = F.get("all", F.lit(0))
    tie = F.exists("all", lambda c: (c["far"] == best["far"]) & (c["kind"] == best["kind"]) & (c["parent"] != best["parent"]))
    resolved = F.coalesce(~tie, F.lit(False))
    return targets.join(ranked, ["doc_id", "pref_no"], "left").select(
        "doc_id", "pref_no", F.when(resolved, F.array_sort(F.array_except(best["parent"], F.col("preferred")))).alias("others"), F.when(resolved, "RESOLVED").otherwise("AMBIGUOUS").alias("status")
    )
