"""The trie of conversations' prefixes: what sharing common beginnings saves.

A node is a sequence of turns (role, text) with which a conversation starts. Its identity
is its depth and 120 bits: the exclusive or of a SHA-256 for each place and turn, so that
the identities along a conversation are running sums, which blocks of turns make apart; a
conversation of any length is never in one task.

Totals of subtrees come by peeling leaves. Nodes are taken together in paths: a node
belongs to the path of that of its members whose hashed id is least. That member passes
all nodes of the path, down to its own last turn, so a path is a run of depths of one
conversation; all children of its nodes but one each are tops of other paths. A path has a
counter of such tops that are not yet finished. Each round, paths whose counter is at
zero send their totals to the nodes above their tops, and counters go down, until the
root's path is done. As ids are hashed, the least member changes about ln(members) times
on the way down, so the rounds grow with the logarithm of the number of conversations,
not with their length, and a long conversation whose beginnings are others' is one path.
Totals of the nodes inside a path are sums from below, again by blocks.

Defined cases: null roles and texts are empty ones; rows without a conversation id are left
out; turns of one number stand in the order of a digest of role and text, null numbers
first; repeated rows are turns each; a conversation without turns is a member of the root;
an empty table has no node. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.llm.util import cut, map_arrow

#: Turns of a conversation that are summed in one task, and ids that are joined in one string.
BLOCK, IDS = 512, 1000


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (1, 2, ...), digest (of role and text), chars of every turn, in order.

    Positions are counted in range partitions of the sorted turns and moved up by what the
    conversation has in earlier ones, so that a conversation may fill many of them.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(part(role)).cast("string"), F.lit(":"), part(role), part(text)).cast("binary"), 256))
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(part(text)).cast("long").alias("chars"))
    rows = rows.where("conv is not null").withColumn("any", F.monotonically_increasing_id())
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("any")]
    dealt = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("conv", "digest", "chars", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("n")))
    ranges = dealt.groupBy("conv", "range").agg(F.min("n").alias("from"), F.count("*").alias("count"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("conv").alias("c"), F.col("range").alias("r"), "from", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    placed = dealt.join(ranges, (F.col("conv") == F.col("c")) & (F.col("range") == F.col("r")))
    return placed.select("conv", (F.col("n") - F.col("from") + F.col("before") + 1).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin as the first of their family does, and their ids with lengths.

    Conversation c takes the first h turns of c - c % family, h = crc32(c) % heads, then its own
    after its first h. A head has less than ``heads`` turns and serves less than ``family`` conversations.
    """
    convs = turns.groupBy("conv").agg(F.count("*").alias("own")).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % heads)
    convs = convs.withColumn("host", F.col("conv") - F.col("conv") % family)
    hosts = convs.select(F.col("conv").alias("host"), F.col("own").alias("host_turns"))
    taken = F.least("h", F.coalesce("host_turns", F.lit(0)))
    convs = cut(convs.join(hosts, "host", "left").select("conv", "host", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    shared = turns.where(F.col("pos") < heads).withColumnRenamed("conv", "host").join(convs.where("taken > 0").drop("h", "length"), "host").where("pos <= taken")
    own = turns.join(convs, "conv").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv", "pos", "digest", "chars"]
    return shared.select(*columns).unionByName(own.select(*columns)), convs.select("conv", "length")


def _sums(rows: DataFrame, key: str, pos: str, sums: dict[str, Column], total, descending: bool = False) -> DataFrame:
    """rows with running totals (``total`` combines them) of columns along pos, in blocks of each key."""
    at = F.col(pos).desc() if descending else F.col(pos).asc()
    rows = rows.withColumn("block", F.floor(F.col(pos) / BLOCK).cast("long"))
    inside = Window.partitionBy(key, "block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("__of").orderBy(F.col("__block").desc() if descending else F.col("__block").asc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col(key).alias("__of"), F.col("block").alias("__block")).agg(*[total(c).alias(f"{n}_all") for n, c in sums.items()])
    blocks = blocks.select("__of", "__block", *[F.coalesce(total(F.col(f"{n}_all")).over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums])
    rows = rows.withColumns({n: total(c).over(inside) for n, c in sums.items()})
    both = rows.join(blocks, (F.col(key) == F.col("__of")) & (F.col("block") == F.col("__block"))).drop("__of", "__block", "block")
    joined = (lambda a, b: a.bitwiseXOR(b)) if total is F.bit_xor else (lambda a, b: a + b)
    return both.withColumns({n: joined(F.col(n), F.col(f"{n}_before")) for n in sums}).drop(*[f"{n}_before" for n in sums])


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids (ascending, comma-joined) of each depth, a, b.

    Ids are joined to strings of a bounded number first; a node's strings then pass through one hash
    in a stream, whatever their number. A digest of a list can't be made in parts.
    """
    parts = ends.groupBy("depth", "a", "b", F.floor(F.col("conv") / IDS).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))
    sorted_parts = parts.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "part")

    def run(batches):
        node, hashed = None, None
        for batch in batches:
            out = []
            for depth, a, b, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "a", "b", "ids")], strict=True):
                if (depth, a, b) == node:
                    hashed.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, hashed.hexdigest()))
                node, hashed = (depth, a, b), hashlib.sha256(ids.encode())
            yield _batch(out)
        if node:
            yield _batch([(*node, hashed.hexdigest())])

    def _batch(out):
        return pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in out], pa.int64()) for k in range(3)], pa.array([r[3] for r in out], pa.string())], ["depth", "a", "b", "ends_sha256"])

    return map_arrow(sorted_parts, run, "depth long, a long, b long, ends_sha256 string")


def peel(paths: DataFrame) -> DataFrame:
    """path, above, above_depth, saved, leaves: totals of each path with all that hangs on it.

    paths: path, above (path of the node over its top, null for the root's), above_depth, saved and leaves
    of its own nodes, waiting (tops that hang on it). A round sends what is finished and lowers the counters.
    """
    open_, done = cut(paths), None
    while True:
        ready = open_.where("waiting = 0").drop("waiting")
        done = ready if done is None else done.unionByName(ready)
        rest = open_.where("waiting > 0")
        if not rest.limit(1).count():
            return done
        sent = ready.where("above is not null").groupBy(F.col("above").alias("path")).agg(F.count("*").alias("n"), F.sum("saved").alias("more"), F.sum("leaves").alias("ends"))
        rest = rest.join(sent, "path", "left")
        got = lambda c: F.coalesce(F.col(c), F.lit(0))
        open_ = cut(rest.select("path", "above", "above_depth", (F.col("saved") + got("more")).alias("saved"), (F.col("leaves") + got("ends")).alias("leaves"), (F.col("waiting") - got("n")).alias("waiting")))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of turns (conv, pos, digest, chars) of convs (conv, length): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    mark = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.hex("digest")), 256)
    word = lambda k: F.conv(F.substring("mark", k, 15), 16, 10).cast("long")
    marked = turns.withColumn("mark", mark).select("conv", "pos", "chars", word(1).alias("ma"), word(16).alias("mb"))
    marked = _sums(marked, "conv", "pos", {"a": F.col("ma"), "b": F.col("mb")}, F.bit_xor)
    zero = F.lit(0).cast("long")
    rows = convs.select("conv", *[zero.alias(c) for c in ("pos", "chars", "ma", "mb", "a", "b")]).unionByName(marked).withColumnRenamed("pos", "depth")
    rows = cut(rows.join(convs, "conv").select("*", (F.col("depth") == F.col("length")).alias("ends")).drop("length"))

    # conv_id and depth name a node; path is the member of the least hash
    least = F.min(F.struct(F.xxhash64(F.col("conv"), F.lit(11)).alias("h"), F.col("conv").alias("c")))["c"]
    above = {"pa": F.min(F.col("a").bitwiseXOR(F.col("ma"))), "pb": F.min(F.col("b").bitwiseXOR(F.col("mb")))}
    nodes = rows.groupBy("depth", "a", "b").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), least.alias("path"), F.min("chars").alias("chars"), *[c.alias(n) for n, c in above.items()])
    nodes = cut(nodes)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("above"))
    linked = nodes.join(parents, ["depth", "pa", "pb"], "left").withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    linked = cut(linked.select("depth", "a", "b", "conv_id", "n_convs", "path", "own", "parent_conv_id", "above"))

    # what hangs on a node: its children, and of those that are tops of other paths their number and totals
    children = linked.where("above is not null").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("path") != F.col("above")).alias("tops"))
    linked = cut(linked.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children", "tops"]))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    top = F.min_by("above", "depth")
    paths = linked.groupBy("path").agg(top.alias("above"), (F.min("depth") - 1).alias("above_depth"), F.sum("own").alias("saved"), F.sum(leaf).alias("leaves"), F.sum("tops").alias("waiting"))
    hung = peel(paths).where("above is not null").groupBy(F.col("above").alias("path"), F.col("above_depth").alias("depth")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("ends"))
    linked = linked.join(hung, ["path", "depth"], "left").fillna(0, ["more", "ends"])
    linked = _sums(linked, "path", "depth", {"saved_tokens": F.col("own") + F.col("more"), "n_leaves": leaf + F.col("ends")}, F.sum, descending=True)

    digests = _digests(rows.where("ends").select("depth", "a", "b", "conv"))
    full = linked.join(digests, ["depth", "a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of a table of conversations (conv_id, turn, role, text) as they are."""
    turns = cut(turns_of(conversations))
    return trie(turns, cut(turns.groupBy("conv").agg(F.count("*").alias("length"))))


def family_trie(conversations: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """The nodes of conversations that begin as the first of their family does."""
    turns = cut(turns_of(conversations))
    rows, convs = rebuilt(turns, family, heads)
    return trie(cut(rows), convs)
