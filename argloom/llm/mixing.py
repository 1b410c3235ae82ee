"""Mixing sources to target weights by capped water-filling, with built-in functions only.

Every source has a weight and a size (words of its documents). Targets share the
budget by weight; a source whose share exceeds ``max_epochs`` times its size is
clamped there and the excess is shared again among the others by weight, until no
target is above its cap. Sorting sources by cap/weight gives that fixed point
directly: the first k are clamped for the smallest k whose water level does not
exceed the next source's cap/weight.

A target of r sizes takes every document floor(r) times, and once more those that
come first in a seeded order until the rest of the target is reached. The order is
by md5 of seed and id; a histogram of its leading 12 bits finds where each source's
cut falls, so that no task ever sorts a whole source.

Defined cases: a null text counts 0 words; null is a source of its own, last in the
order; a source of size 0 has target 0, and none of its rows is taken; an empty table gives an empty result;
repeated rows each count and are each decided on. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.llm.util import cut, n_words


def measure(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", further: tuple[str, ...] = ()) -> DataFrame:
    """id, src, size of every row, and further columns."""
    return docs.select(F.col(doc_id).alias("id"), F.col(source).alias("src"), n_words(F.col(text)).alias("size"), *further)


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, budget: float = 1.0) -> DataFrame:
    """src, source_size, target of each source. Weights repeat over the sources in code-point order, null last."""
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("src").asc_nulls_last())
    everything = Window.partitionBy()
    sources = sized.groupBy("src").agg(F.sum("size").alias("source_size"))  # one row per source
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * max_epochs
    ranked = (
        sources.withColumn("weight", weight)
        .withColumn("level", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(budget))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("caps_before", F.sum(cap).over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("weight_before", F.sum("weight").over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("water", (F.col("total") - F.coalesce("caps_before", F.lit(0))) / (F.col("all_weight") - F.coalesce("weight_before", F.lit(0))))
    )
    # of the levels at which the next source need not be clamped, the first holds; with none, all are clamped
    level = F.min_by(F.when(F.col("water") <= F.col("level"), F.col("water")), F.when(F.col("water") <= F.col("level"), F.col("level"))).over(everything)
    return ranked.withColumn("water", level).select(
        "src", "source_size",
        F.when(F.col("water").isNull() | (F.col("level") <= F.col("water")), cap.cast("double")).otherwise(F.col("weight") * F.col("water")).alias("target"),
    )


def copies(sized: DataFrame, target: DataFrame, seed: int = 17) -> DataFrame:
    """sized with source_size, target and how often the mix repeats each row. Further columns of sized decide between rows of one id and size, and stay."""
    further = [c for c in sized.columns if c not in ("id", "src", "size")]
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    keyed = sized.withColumn("order", order).withColumn("slot", F.substring("order", 1, 3))
    before = Window.partitionBy("src").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = keyed.groupBy("src", "slot").agg(F.sum("size").alias("slot_size")).withColumn("slot_start", F.coalesce(F.sum("slot_size").over(before), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = (
        slots.join(target.withColumnRenamed("src", "of"), F.col("src").eqNullSafe(F.col("of")))
        .withColumn("whole", whole)
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        .select(F.col("src").alias("of"), F.col("slot").alias("at"), "slot_start", "source_size", "target", "whole", "need")
    )
    upto = Window.partitionBy("src", "slot").orderBy("order", "id", "size", *further).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("slot_start") + F.col("in_slot")
    # the row at the cut counts if that comes nearer; where nothing is needed, not even rows without words come once more
    once_more = ((F.col("need") > 0) & (2 * end - F.col("size") <= 2 * F.col("need"))).cast("long")
    return (
        keyed.withColumn("in_slot", F.sum("size").over(upto))
        .join(plan, F.col("src").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("at")))
        .select("id", "src", "size", "source_size", "target", (F.col("whole") + once_more).alias("copies"), *further)
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """Per row of docs: id, src, size, source_size, target, copies."""
    sized = cut(measure(docs))
    return copies(sized, targets(sized, weights, max_epochs), seed)


def content_key(doc_id: Column, source: Column, text: Column) -> Column:
    """One digest of a row's id, source and text, nulls told apart."""
    parts = [x for c in (doc_id, source, text) for x in (F.coalesce(F.length(c.cast("string")), F.lit(-1)).cast("string"), F.coalesce(c.cast("string"), F.lit("")))]
    return F.unhex(F.sha2(F.concat_ws(":", *parts), 256))


def sample(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mixed corpus itself: rows of docs, each as often as the mix repeats it. Rows that agree in id, source and text are numbered, and as many as the mix says get a copy more."""
    sized = cut(measure(docs.withColumn("__key", content_key(F.col("doc_id"), F.col("source"), F.col("text"))), further=("__key",)))
    times = copies(sized, targets(sized, weights, max_epochs), seed).groupBy(F.col("__key").alias("__of"))
    # copies of such rows differ by one at most
    times = times.agg(F.min("copies").alias("__least"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("__more")).where("__least + __more > 0")
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"))
    row = row.withColumn("__key", content_key(F.col("__row.doc_id"), F.col("__row.source"), F.col("__row.text")))
    row = row.withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0))))
    number = F.col("__least") + (F.col("__nth") <= F.col("__more")).cast("long")
    again: Column = F.explode(F.array_repeat("__row", number.cast("int")))
    return row.join(times, F.col("__key") == F.col("__of")).select(again.alias("__row")).select("__row.*")
