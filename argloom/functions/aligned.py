"""Places of spans that were slightly reworded: words inserted, left out, replaced or moved.

A place is a stretch of at most LONGEST times the span's words. It holds as many of them,
in order, as the longest chain of word matches (text place, span place) in which both
rise. Of all stretches the one with the most words counts, then the shortest, then the
first; it stands if that is COVERED of the span.

Words of a text and of its span meet in an equi-join, and matches with those that follow
within reach in another one, by buckets of places. So the work is the matches times the
span's length, and no row looks at a whole text. Spark takes
exploded words for as small as the table they come from, so every join says that it is
to be sorted and merged: none of them may be broadcast through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.functions.text import fold, locate_span, trimmed_span, words

# Fewest words of a span, least share of them found, greatest stretch over which they lie.
FEWEST, COVERED, LONGEST = 5, 0.8, 1.4
PLACE = "struct<start: int, end: int>"


def _chain(matches: Column) -> Column:
    """Of matches (i, minus: j negated) sorted: length of the longest chain and the place i at which it is first reached. The fold keeps the least last j of a chain of each length."""
    start = F.struct(F.expr("CAST(array() AS ARRAY<INT>)").alias("ends"), F.lit(-1).alias("at"))

    def add(state: Column, m: Column) -> Column:
        j, ends = -m["minus"], state["ends"]
        shorter = F.filter(ends, lambda e: e < j)
        longer = F.slice(ends, F.size(shorter) + 2, F.size(ends))
        grown = F.size(shorter) == F.size(ends)
        return F.struct(F.concat(shorter, F.array(j), longer).alias("ends"), F.when(grown, m["i"]).otherwise(state["at"]).alias("at"))

    return F.aggregate(matches, start, add, lambda s: F.struct(F.size(s["ends"]).alias("length"), s["at"].alias("at")))


def places(rows: DataFrame, keys: list[str], text: str = "text", span: str = "span") -> DataFrame:
    """keys, start and end of the stretch of each row's text that holds its span; rows without one give none. keys tell rows apart."""
    sought = rows.select(*keys, F.transform(words(F.col(span)), fold).alias("w")).withColumn("n", F.size("w")).where(F.col("n") >= FEWEST)
    reach = F.floor(F.col("n") * LONGEST).cast("int")
    said = sought.select(*keys, "n", reach.alias("reach"), F.posexplode("w").alias("j", "word"))
    given = rows.where(F.col(span).isNotNull()).select(*keys, F.posexplode(F.transform(words(F.col(text)), fold)).alias("i", "word"))
    met = given.join(said.hint("merge"), [*keys, "word"]).drop("word")
    # the matches after each, within reach
    begins = met.groupBy(*keys, F.col("i").alias("first")).agg(F.first("reach").alias("over"))
    begins = begins.withColumn("bucket", F.explode(F.array(F.floor(F.col("first") / F.col("over")), F.floor(F.col("first") / F.col("over")) + 1)))
    near = met.withColumn("bucket", F.floor(F.col("i") / F.col("reach"))).join(begins.hint("merge"), [*keys, "bucket"]).where("i >= first AND i < first + over")
    windows = near.groupBy(*keys, "first", "n").agg(F.sort_array(F.collect_list(F.struct("i", (-F.col("j")).alias("minus")))).alias("matches"))
    chained = windows.where(F.size("matches") >= COVERED * F.col("n")).select(*keys, "n", "first", _chain(F.col("matches")).alias("c"))
    held = chained.where(F.col("c.length") >= COVERED * F.col("n"))
    best = held.groupBy(*keys).agg(F.max(F.struct(F.col("c.length"), (F.col("first") - F.col("c.at")).alias("short"), (-F.col("first")).alias("early"))).alias("b"))
    best = best.select(*keys, (-F.col("b.early")).alias("first"), (-F.col("b.early") - F.col("b.short")).alias("last"))
    # from word numbers to characters: what lies before a word is the gaps and words before it
    gaps, size = F.transform(F.split(F.col(text), r"(?U)\w+", -1), F.length), F.transform(words(F.col(text)), F.length)
    total = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda a, x: a + x)
    at = best.join(rows.hint("merge"), keys).withColumns({"gaps": gaps, "sizes": size})
    start = total(F.col("gaps"), F.col("first") + 1) + total(F.col("sizes"), F.col("first"))
    end = total(F.col("gaps"), F.col("last") + 1) + total(F.col("sizes"), F.col("last") + 1)
    return at.select(*keys, start.alias("start"), end.alias("end"))


def located(rows: DataFrame, keys: list[str], text: str = "text", span: str = "span") -> DataFrame:
    """rows with ``at``: {start, end} of the span as ``locate_span`` finds it, else of the stretch that holds it reworded, else null. keys tell rows apart."""
    # dealt once, as few large rows of a file may be one task's, and joins by keys find them in place
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    exact = rows.withColumn("at", locate_span(F.col(text), F.col(span)))
    open_ = exact.where("at IS NULL").select(*keys, F.col(text).alias("text"), trimmed_span(F.col(span)).alias("span"))
    found = places(open_, keys).select(*keys, F.struct("start", "end").cast(PLACE).alias("near"))
    return exact.join(found.hint("merge"), keys, "left").withColumn("at", F.coalesce("at", "near")).drop("near")
