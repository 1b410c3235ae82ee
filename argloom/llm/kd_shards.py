"""Sharding by a k-d tree over metadata, with built-in functions only.

A row weighs its text's UTF-8 bytes plus one. The root holds all rows and as many leaves
as are asked for (or as reach the target bytes). A node with k leaves is split along the
dimension in which its rows spread widest, measured against the spread of the whole
table, at the weighted median: the first floor(k/2) leaves get their share of the bytes,
to the nearest row. Rows of equal place in the dimension follow the hash of their text,
so equal texts stand together and are parted only where a cut falls among them, then
that of their id, then their number; so the cut is exact whatever repeats.

The medians are found in all nodes of a level at once, over a table of numbers, never of
texts: byte histograms of BUCKETS equal ranges narrow each node's cut to one range, then
to a range of that, until few rows (FEW) are left, which are sorted in one array a node.
A histogram holds BUCKETS sums a node however many rows there are, so a key that a third
of the rows share costs what any other does. A level takes two to four passes; the
deepest keys, 48 bits, are exhausted after four histograms each.

Dimensions: text columns count by the six bytes after what all values have in common at
their start, in code-point order; others as doubles between least and greatest. Nulls
and NaN come first.

Defined cases: a null text weighs 1 and has the checksum 0; equal texts weigh alike but
may part; repeated rows part as the sizes demand and are interchangeable; a table with
fewer rows than shards leaves shards empty; an empty table gives an empty result; a text
heavier than a shard's share makes its shard heavier. Other columns are not looked at.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.llm.util import cut

#: Ranges of a histogram, and rows that are few enough to be sorted in one array.
BUCKETS, FEW = 1024, 250
#: Bits of a key, and the keys in which rows are compared: dimension, text, id, number.
BITS, KEYS = 48, 4
#: Rows that are numbered together in a shard, on average.
NUMBERED = 500


def _hash(value: Column) -> Column:
    """48 bits of a digest, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def codes(rows: DataFrame, dims: tuple[str, ...]) -> list[Column]:
    """A long per dimension of rows, in the order of its values: from 0 below 2^48, nulls -1. Rows are looked over once for least and greatest values."""
    kinds = {c: rows.schema[c].dataType.typeName() for c in dims}
    number = {c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")) for c in dims if kinds[c] != "string"}
    ends = [x for c in dims for x in ((F.min(F.hex(c)), F.max(F.hex(c))) if kinds[c] == "string" else (F.min(number[c]), F.max(number[c])))]
    found = rows.agg(*[e.alias(f"e{k}") for k, e in enumerate(ends)]).first()
    out = []
    for k, c in enumerate(dims):
        least, most = found[2 * k], found[2 * k + 1]
        if kinds[c] == "string":
            shared = len(os.path.commonprefix([least or "", most or ""])) // 2 * 2
            code = F.conv(F.rpad(F.substring(F.hex(c), shared + 1, BITS // 4), BITS // 4, "0"), 16, 10).cast("long")
        elif least is None or least == most:
            code = F.when(number[c].isNotNull(), F.lit(0)).cast("long")
        else:
            code = F.floor((number[c] - least) / (most - least) * F.lit(float(2**BITS - 1))).cast("long")
        out.append(F.coalesce(code, F.lit(-1).cast("long")))
    return out


def measure(docs: DataFrame, dims: tuple[str, ...], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """node (1), n (a number for the row), id, size, crc, c0, c1, ... (dimensions), k1, k2 (text, id) of every row: written once, without texts."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return cut(docs.select(
        F.lit(1).cast("long").alias("node"), F.monotonically_increasing_id().alias("n"), F.col(doc_id).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("crc"), *[c.alias(f"c{k}") for k, c in enumerate(codes(docs, dims))], _hash(F.col(text)).alias("k1"), _hash(F.col(doc_id)).alias("k2"),
    ))


def route(rows: DataFrame, splits: DataFrame, n_dims: int) -> DataFrame:
    """rows one level further down: those of a split node go to its left child up to the cut, else to its right one."""
    keys = F.struct(_key(n_dims, "axis").alias("p0"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n").alias("p3"))
    half = F.floor(F.col("leaves") / 2)
    # one row a node, so never more than twice the shards
    at = rows.join(F.broadcast(splits.select("node", "axis", "cut")), "node", "left")
    at = at.withColumn("side", F.when(F.col("axis").isNull(), F.lit(None)).when(keys <= F.col("cut"), F.lit(0)).otherwise(F.lit(1)))
    down = {
        "node": F.when(F.col("side").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.col("side")),
        "first": F.when(F.col("side") == 1, F.col("first") + half).otherwise(F.col("first")),
        "leaves": F.when(F.col("side") == 0, half).when(F.col("side") == 1, F.col("leaves") - half).otherwise(F.col("leaves")),
    }
    return at.withColumns(down).drop("axis", "cut", "side")


def _key(n_dims: int, axis: str) -> Column:
    return F.element_at(F.array(*[F.col(f"c{k}") for k in range(n_dims)]), F.col(axis) + 1)


def _nodes(rows: DataFrame, n_dims: int) -> DataFrame:
    """Per node: its bytes and the ends of its rows in each dimension."""
    ends = [x for k in range(n_dims) for x in (F.min(f"c{k}").alias(f"a{k}"), F.max(f"c{k}").alias(f"b{k}"))]
    return rows.groupBy("node", "leaves").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *ends)


def _widest(n_dims: int) -> Column:
    """The dimension in which a node spreads widest, as a share of the table's spread; of equals the first."""
    spread = lambda k: F.when(F.col(f"w{k}") > 0, (F.col(f"b{k}") - F.col(f"a{k}")) / F.col(f"w{k}")).otherwise(F.lit(0.0))
    widest = F.greatest(*[spread(k) for k in range(n_dims)], F.lit(0.0))
    choice = F.lit(0)
    for k in reversed(range(n_dims)):
        choice = F.when(spread(k) == widest, F.lit(k)).otherwise(choice)
    return choice.cast("int")


def medians(rows: DataFrame, nodes: DataFrame, n_dims: int) -> DataFrame:
    """node, axis, cut: for each of nodes (node, axis, want, lo, hi) the keys of the last row whose bytes, summed in order, come nearest to want."""
    # the range under search: keys before ``deep`` are fixed to p0, p1, p2, that one is between lo and hi; before: bytes below the range
    fixed = [F.lit(0).cast("long").alias(f"p{k}") for k in range(KEYS - 1)]
    found = cut(nodes.select("node", "axis", "want", "rows", F.lit(0).alias("deep"), "lo", "hi", F.lit(0).cast("long").alias("before"), *fixed))
    last_number = rows.agg(F.max("n")).first()[0]

    def within(found: DataFrame) -> DataFrame:
        at = rows.join(F.broadcast(found), "node").withColumn("keys", F.array(_key(n_dims, "axis"), "k1", "k2", "n"))
        same = [(F.col("deep") <= k) | (F.col("keys")[k] == F.col(f"p{k}")) for k in range(KEYS - 1)]
        at = at.withColumn("key", F.element_at("keys", F.col("deep") + 1))
        return at.where(F.col("key").between(F.col("lo"), F.col("hi")) & same[0] & same[1] & same[2])

    while found.where(F.col("rows") > FEW).limit(1).count():
        wide = F.floor((F.col("hi") - F.col("lo")) / BUCKETS).cast("long") + 1
        sums = within(found.where(F.col("rows") > FEW)).groupBy("node", F.floor((F.col("key") - F.col("lo")) / wide).alias("at"))
        sums = sums.agg(F.sum("size").alias("s"), F.count("*").alias("c"), F.min("key").alias("a"), F.max("key").alias("b"))
        steps = sums.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "s", "c", "a", "b"))).alias("steps"))
        # the first range that reaches what is wanted, else the last; bytes up to its start
        reach = F.aggregate(
            "steps", F.struct(F.col("before").alias("sum"), F.lit(0).cast("long").alias("start"), F.lit(None).cast("struct<at:bigint,s:bigint,c:bigint,a:bigint,b:bigint>").alias("step")),
            lambda t, x: F.when(t["step"].isNotNull() & (t["sum"] >= F.col("want")), t).otherwise(F.struct((t["sum"] + x["s"]).alias("sum"), t["sum"].alias("start"), x.alias("step"))),
        )
        went = found.join(F.broadcast(steps), "node").withColumn("r", reach).withColumn("one", F.col("r.step.a") == F.col("r.step.b"))
        deeper = F.col("one") & (F.col("deep") < KEYS - 1)
        last = F.when(F.col("deep") + 1 == KEYS - 1, F.lit(last_number)).otherwise(F.lit(2**BITS - 1))
        went = went.select(
            "node", "axis", "want", F.col("r.step.c").alias("rows"), F.when(deeper, F.col("deep") + 1).otherwise(F.col("deep")).alias("deep"),
            F.when(deeper, F.lit(0)).otherwise(F.col("r.step.a")).alias("lo"), F.when(deeper, last).otherwise(F.col("r.step.b")).alias("hi"), F.col("r.start").alias("before"),
            *[F.when(deeper & (F.col("deep") == k), F.col("r.step.a")).otherwise(F.col(f"p{k}")).alias(f"p{k}") for k in range(KEYS - 1)],
        )
        found = cut(went.unionByName(found.where(F.col("rows") <= FEW)))
    row = F.struct(*[F.col("keys")[k].alias(f"p{k}") for k in range(KEYS)], "size")
    few = within(found).groupBy("node", "axis", "want", "before").agg(F.sort_array(F.collect_list(row)).alias("few"))
    # of the rows in order, the last whose middle is not past what is wanted
    ended = F.aggregate(
        "few", F.struct(F.col("before").alias("sum"), F.expr("cast(null as struct<p0:bigint,p1:bigint,p2:bigint,p3:bigint>)").alias("cut")),
        lambda t, x: F.struct((t["sum"] + x["size"]).alias("sum"), F.when(2 * t["sum"] + x["size"] <= 2 * F.col("want"), F.struct(*[x[f"p{k}"].alias(f"p{k}") for k in range(KEYS)])).otherwise(t["cut"]).alias("cut")),
    )["cut"]
    first = F.col("few")[0]
    none = F.struct(*[(first[f"p{k}"] - (1 if k == KEYS - 1 else 0)).alias(f"p{k}") for k in range(KEYS)])
    return cut(few.select("node", "axis", F.coalesce(ended, none).alias("cut")))


def tree(rows: DataFrame, n_dims: int, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """rows with ``shard``: the leaf of the k-d tree that a row falls into, numbered from left to right. Rows are those of ``measure``."""
    # of a row's node: its number, its leaves, and the leaves to their left
    rows = rows.withColumns({"leaves": F.lit(1).cast("long"), "first": F.lit(0).cast("long")})
    whole = _nodes(rows, n_dims).first()
    if whole is None:
        return rows.withColumnRenamed("first", "shard").drop("node", "leaves")
    shards = shards or max(1, -(-whole["bytes"] // target_bytes))
    rows = rows.withColumn("leaves", F.lit(shards).cast("long"))
    wide = [F.lit(whole[f"b{k}"] - whole[f"a{k}"]).alias(f"w{k}") for k in range(n_dims)]
    end = lambda side: F.element_at(F.array(*[F.col(f"{side}{k}") for k in range(n_dims)]), F.col("axis") + 1)
    for level in range((shards - 1).bit_length()):
        at = _nodes(rows, n_dims).where("leaves > 1").select("*", *wide).withColumn("axis", _widest(n_dims))
        want = F.col("bytes") * F.floor(F.col("leaves") / 2) / F.col("leaves")
        at = at.select("node", "axis", "rows", end("a").alias("lo"), end("b").alias("hi"), want.alias("want"))
        rows = route(rows, medians(rows, at, n_dims), n_dims)
        if level % 6 == 5:  # a level is a join more in the plan
            rows = cut(rows)
    return rows.withColumnRenamed("first", "shard").drop("node", "leaves")


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """rows with ``slot``: 0, 1, 2, ... in each shard, in an order of hashes. Counts of hash ranges place each range, and rows are numbered inside theirs; a range that many rows of one hash fill is parted by their numbers."""
    total, last = rows.agg(F.count("*"), F.max("n")).first()
    parts = 1 << max(0, min(20, (total // (shards * NUMBERED)).bit_length()))
    at = F.col("k2").bitwiseXOR(F.col("k1"))
    cells = rows.withColumn("h", at).withColumn("cell", F.floor(at / (2**BITS // parts)).cast("long"))
    heavy = cells.groupBy("shard", "cell").count().where(F.col("count") > 20 * NUMBERED).select("shard", "cell", F.col("count").alias("heavy"))
    # ranges of more than twenty times the usual rows: as many as all rows make at most, so a small part of the cells
    cells = cells.join(heavy, ["shard", "cell"], "left")
    parted = F.when(F.col("heavy").isNotNull(), F.floor(F.col("n") / ((last or 0) + 1) * F.ceil(F.col("heavy") / NUMBERED)).cast("long")).otherwise(F.lit(0).cast("long"))
    cells = cells.withColumn("part", parted)
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("shard", "cell", "part").agg(F.count("*").alias("c"))
    starts = starts.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    inside = Window.partitionBy("shard", "cell", "part").orderBy("h", "id", "n")
    cells = cells.withColumn("nth", F.row_number().over(inside))
    return cells.join(starts, ["shard", "cell", "part"]).withColumn("slot", (F.col("start") + F.col("nth") - 1).cast("long")).drop("h", "cell", "part", "heavy", "nth", "start")


def shard(docs: DataFrame, dims: tuple[str, ...] = ("source", "lang", "n_chars"), shards: int | None = 16, target_bytes: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, shard, slot (from 0, without gaps, in each shard). Either the number of shards or their target bytes is given."""
    rows = measure(docs, dims, text, doc_id)
    placed = cut(tree(rows, len(dims), shards, target_bytes))
    n = shards or (placed.agg(F.max("shard")).first()[0] or 0) + 1
    return numbered(placed, n).select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), "slot")
