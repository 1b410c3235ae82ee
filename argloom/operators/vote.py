"""Votes over repeated answers, and the repair of incomplete ballots. Answers are a table: doc_id, stage, item, ballot_no, value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def majority(answers: DataFrame, keys: list[str], value: str = "value", fallback=None) -> DataFrame:
    """keys and the value that more than half of the ballots give, else the fallback."""
    tally = answers.groupBy(*keys, value).agg(F.count("*").alias("n"))
    out = tally.groupBy(*keys).agg(F.sum("n").alias("ballots"), F.max_by(F.struct(F.col(value).alias("v"), "n"), F.col("n")).alias("top"))
    return out.select(*keys, F.when(F.col("top.n") * 2 > F.col("ballots"), F.col("top.v")).otherwise(F.lit(fallback)).alias(value))


def majority_tags(answers: DataFrame, keys: list[str], tags: str = "tags", none: str = "N", held: DataFrame | None = None) -> DataFrame:
    """keys and the tags that more than half of the ballots hold, or [none].

    held: some of keys and ``ballots``, the number held; a silent ballot then counts
    against a tag. Without it, the ballots are those that answered.
    """
    ballots = answers.groupBy(*keys).agg(F.count("*").alias("ballots"))
    if held is not None:
        ballots = ballots.drop("ballots").join(held, [k for k in keys if k in held.columns])
    won = answers.select(*keys, F.explode(tags).alias("tag")).groupBy(*keys, "tag").agg(F.count("*").alias("n")).join(ballots, keys).where("n * 2 > ballots")
    kept = won.groupBy(*keys).agg(F.sort_array(F.collect_list("tag")).alias(tags))
    return ballots.select(*keys).join(kept, keys, "left").withColumn(tags, F.coalesce(tags, F.array(F.lit(none))))


def majority_support(answers: DataFrame, held: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys and each value (a premise of a conclusion, a whole preference row) that more than half of all ballots held give. A ballot counts once a value."""
    by = [k for k in keys if k in held.columns]
    tally = answers.select(*keys, value, "ballot_no").distinct().groupBy(*keys, value).agg(F.count("*").alias("n"))
    return tally.join(held, by).where("n * 2 > ballots").select(*keys, value)


def realigned(ballot: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Answers under the numbers that were asked for: kept if these match, renumbered by place if a ballot counted from 1, else nothing."""
    counts = expected.groupBy(*keys).agg(F.count("*").alias("asked"), F.sort_array(F.collect_list("item")).alias("items"))
    given = ballot.join(counts, keys)
    inside = F.sum((~F.array_contains("items", F.col("item"))).cast("int")).over(Window.partitionBy(*keys))
    n = F.count("*").over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("item"))
    from_one = F.sum((F.col("place") != F.col("item")).cast("int")).over(Window.partitionBy(*keys))
    df = given.withColumn("outside", inside).withColumn("n", n).withColumn("place", place).withColumn("shifted", from_one)
    item = F.when(F.col("outside") == 0, F.col("item")).when((F.col("shifted") == 0) & (F.col("n") == F.col("asked")), F.get("items", F.col("place") - 1))
    return df.select(*keys, item.alias("item"), "value").where("item IS NOT NULL")


def repaired(ballots: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ballot_no, item, value: ballots (keys, ballot_no, item, value) under the numbers that were asked for (expected: keys, item).

    A number given twice counts as it was first (by value). A ballot whose numbers are as
    many as were asked, follow each other without a gap and begin at 1 or are all others
    than those asked was counted anew: its places go to the items in order. From any
    other, numbers that were not asked for are dropped.
    """
    asked = expected.groupBy(*keys).agg(F.sort_array(F.collect_set("item")).alias("items"))
    once = ballots.groupBy(*keys, "ballot_no", "item").agg(F.min("value").alias("value"))
    given = once.groupBy(*keys, "ballot_no").agg(F.sort_array(F.collect_list(F.struct("item", "value"))).alias("given"))
    both = given.join(asked, keys)
    numbers = F.transform("given", lambda x: x["item"])
    run = (F.size("given") == F.size("items")) & (F.element_at(numbers, -1) - F.element_at(numbers, 1) == F.size("items") - 1)
    run = run & ((F.element_at(numbers, 1) == 1) | ~F.arrays_overlap(numbers, "items"))
    anew = F.transform("given", lambda x, k: F.struct(F.get("items", k).alias("item"), x["value"].alias("value")))
    own = F.filter("given", lambda x: F.array_contains("items", x["item"]))
    return both.select(*keys, "ballot_no", F.inline(F.when(run & (numbers != F.col("items")), anew).otherwise(own)))


def fullest(ballots: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the ballots that answer all that was asked; if none does, the one that answers most (of equals the first)."""
    asked = expected.groupBy(*keys).agg(F.count_distinct("item").alias("asked"))
    held = ballots.groupBy(*keys, "ballot_no").agg(F.count_distinct("item").alias("n")).join(asked, keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "ballot_no"))
    kept = held.withColumn("rank", rank).where("n = asked OR rank = 1").select(*keys, "ballot_no")
    return ballots.join(kept, [*keys, "ballot_no"], "left_semi")


def missing(ballot: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """What was asked for and not answered."""
    return expected.join(ballot.select(*keys, "item").distinct(), [*keys, "item"], "left_anti")


def batches(items: DataFrame, size: int, keys: list[str], order: str = "item") -> DataFrame:
    """items with batch_no: fixed numbers in a row of each key."""
    return items.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size).cast("int"))
