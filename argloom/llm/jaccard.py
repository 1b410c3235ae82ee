"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Two documents are linked if the Jaccard similarity of their sets of word n-grams is at
least ``threshold``.

1. Texts with the same set form a class of copies; its smallest id stands for it.
2. Each class has ``trees`` signatures of ``deepest`` MinHash values of one byte. Rows
   of one tree that agree in the first values, down to the shallowest depth that the
   recall can ask for, are one subtree; those of one row go no further.
3. The signatures of a subtree are sorted, which makes it a prefix trie: the longest
   common prefix of two is the least of those between neighbours in the order. Matching
   starts at whole signatures, and prefixes are shortened only while a pair that meets
   at that length, linked as weakly as the sizes of its sets allow, would be missed
   with more than 1 - ``recall``: two sets of 10 and 11 n-grams that are linked share
   at least 0.91, so a longer prefix finds them. ``depth`` is where a class stopped.
4. A pair belongs to the first tree in which it meets, so it is verified once. Pairs
   whose signatures agree in so few of all values that a link would do so with
   probability 1e-9 at most are dropped before any text moves.
5. Texts move to the subtrees that have pairs of theirs, and sizes of intersections are
   counted exactly. The number of links of each class and a spanning forest of the
   links leave; classes of near copies are the connected components of those.

No pair of documents is ever a row, and copies cost one entry per class. A subtree of up
to ``cell`` classes and WORDS words is one cell. A larger one is cut by hash into blocks,
and each pair of blocks is a cell. With k times the bound it has the square root of k
blocks, so that the rows dealt grow with k ** 1.5 and a cell with k ** 0.5; from RATIO
squared times the bound on, blocks stay at RATIO times the bound, which is what a task
holds at most. Cells stand one after the other in sorted partitions.

Defined cases: a text of fewer than n words has one n-gram, all its words; a text
without words has none, is linked to nothing and is a class of its own; rows of one id
are taken as rows; a null id stands last; other columns are not looked at. The plan of
docs must give the same rows in the same partitions when it runs again (as a table that
is read does): texts are found again by row number, and a row that is not the one
sketched is an error.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.llm.util import attach, by_row, cut, map_arrow

U64 = np.uint64
#: Pairs looked at together, and rows of a cell on each side of them; words that need no cut, and how many times that (or ``cell``) a block has at most; pairs a set from which on intersections are counted by a matrix product.
PAIRS, TILE, WORDS, RATIO, DENSE = 100_000, 316, 500_000, 8, 4


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of ASCII-blank-separated words."""
    import xxhash

    words = (text or b"").split()
    if not words:
        return np.zeros(0, U64)
    of = xxhash.xxh3_64_intdigest
    if len(words) <= n:
        return np.array([of(b" ".join(words))], U64)
    h = np.fromiter((of(w) for w in words), U64, len(words))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):  # order matters: each word is mixed in at its place
        out = (out ^ (out >> U64(29))) * U64(0xBF58476D1CE4E5B9) + h[k : len(h) - n + 1 + k]
    out = (out ^ (out >> U64(32))) * U64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> U64(29)))


def depth_for(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """How far prefixes are shortened: the longest at which a pair at the threshold still meets with probability recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(depth: int, trees: int, recall: float) -> float:
    """The similarity from which on a pair meets at a depth in some tree with probability recall."""
    return (1 - (1 - recall) ** (1 / trees)) ** (1 / depth)


@lru_cache(maxsize=32)
def least_agreement(values: int, threshold: float, missed: float = 1e-9) -> int:
    """So many of all values agree for a pair at the threshold, but for a probability ``missed``."""
    total, k = 0.0, 0
    while k < values:
        total += math.exp(math.lgamma(values + 1) - math.lgamma(k + 1) - math.lgamma(values - k + 1) + k * math.log(threshold) + (values - k) * math.log1p(-threshold)) if threshold < 1 else 0.0
        if total > missed:
            return k
        k += 1
    return values


def needed(n: np.ndarray, m: np.ndarray, threshold: float, trees: int, deepest: int, recall: float) -> np.ndarray:
    """The longest prefix at which sets of n and m n-grams, linked as weakly as they can be, still meet with probability recall; 0 if they cannot be linked."""
    common = np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
    weakest = common / (n + m - common)
    depth = np.ones(len(n), np.int64)
    for d in range(2, deepest + 1):
        depth[weakest >= least_similarity(d, trees, recall)] = d
    return np.where(common <= np.minimum(n, m), depth, 0)


def sketches(docs: DataFrame, n: int, trees: int, deepest: int, seed: int = 11) -> DataFrame:
    """Of docs (id, row, t, sha): id, row, sha, set (128-bit digest of the shingle set as text, null without words), size, words, sketch (trees x deepest MinHash values, one byte each)."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, trees * deepest, dtype=np.uint64) * U64(2) + U64(1)
    b = rng.integers(0, 2**63, trees * deepest, dtype=np.uint64)
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("sha", pa.string()), ("set", pa.string()), ("size", pa.int64()), ("words", pa.int64()), ("sketch", pa.binary())])

    def run(batches):
        import xxhash

        for batch in batches:
            out = []
            for t in batch.column(2).to_pylist():
                s = shingles(t, n)
                if not len(s):
                    out.append((None, 0, 0, None))
                    continue
                least = np.full(len(a), 2**32 - 1, np.uint32)
                for k in range(0, len(s), 4096):
                    h = ((s[k : k + 4096, None] * a + b) >> U64(32)).astype(np.uint32)
                    np.minimum(least, h.min(axis=0), out=least)
                out.append((xxhash.xxh3_128_hexdigest(s.tobytes()), len(s), len(s) + n - 1, (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array(c, schema.field(k + 3).type) for k, c in enumerate(columns))], schema=schema)

    return map_arrow(docs, run, "id long, row long, sha string, set string, size long, words long, sketch binary")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (smallest node of its component) of edges (a, b): alternate large-star and small-star steps."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        # large star: link every larger neighbour to the smallest of the neighbourhood
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: link smaller neighbours and the node to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").distinct())
        same = F.xxhash64("u", "v").cast("decimal(38,0)")
        now, was = (e.agg(F.count("*").alias("n"), F.sum(same).alias("s")).first() for e in (new, edges))
        edges = new
        if tuple(now) == tuple(was):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())


def compare(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of links between shingle sets, by exact intersection sizes."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = times[at] > 1  # what one set alone has is in no intersection
    order = np.argsort(at[shared], kind="stable")
    columns, owners = at[shared][order], owner[shared][order]
    columns = np.cumsum(np.diff(columns, prepend=columns[:1]) > 0) if len(columns) else columns
    common = np.zeros((n, n), np.float32)  # counts stay far below 2^24
    for k in range(0, (columns[-1] + 1) if len(columns) else 0, 4096):
        low, high = np.searchsorted(columns, [k, k + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[owners[low:high], columns[low:high] - k] = 1
        common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    links = common >= threshold * union - 1e-9
    np.fill_diagonal(links, False)
    return links


def cells(batches, bound: int):
    """Tables of whole cells (rows that agree in key, i and j, which stand together), of ``bound`` rows or more where there are as many."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= bound:
            t = pa.Table.from_batches(held)
            start = last_start(t)
            if start:
                yield t.slice(0, start)
            held, rows = t.slice(start).to_batches(), t.num_rows - start
    if rows:
        yield pa.Table.from_batches(held)


def last_start(t: pa.Table) -> int:
    """Where the last cell of a table begins."""
    same = np.ones(t.num_rows, bool)
    for c in ("key", "i", "j"):
        x = t.column(c).to_numpy()
        same &= x == x[-1]
    return int(t.num_rows - np.argmin(same[::-1])) if not same.all() else 0


class Subtrees:
    """Cells of subtrees: which of their pairs are candidates, found in sorted signatures."""

    def __init__(self, t: pa.Table, threshold: float, trees: int, deepest: int, recall: float):
        self.options, self.trees, self.deepest = (threshold, trees, deepest, recall), trees, deepest
        column = lambda c: t.column(c).to_numpy()
        self.size, self.block, self.tree = column("size"), column("block"), column("tree")
        self.cross = column("i") != column("j")  # pairs within a block belong to its own cell
        self.sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, trees, deepest)
        key, i, j = (column(c) for c in ("key", "i", "j"))
        cell = np.zeros(len(key), np.int64)
        cell[1:] = np.cumsum((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        # the tries: rows of a cell in the order of their signatures, and the prefix that each has in common with the row before
        own = self.sketch[np.arange(len(cell)), self.tree]
        self.order = np.lexsort((*own.T[::-1], cell))
        own, self.cell = own[self.order], cell[self.order]
        common = np.zeros(len(cell), np.int64)
        common[1:] = np.where(self.cell[1:] == self.cell[:-1], np.logical_and.accumulate(own[1:] == own[:-1], axis=1).sum(axis=1), -1)
        #: At each depth, the number of the node that a row lies under.
        self.nodes = np.array([np.cumsum(common < d) for d in range(deepest + 1)])

    def pairs(self):
        """Some at a time: rows a and b of pairs of a cell, and the depth that each needs."""
        for a, b in self.places():
            x, y = self.order[a], self.order[b]
            ok = (self.tree[x] == self.tree[y]) & (~self.cross[x] | (self.block[x] != self.block[y]))
            a, b, x, y = a[ok], b[ok], x[ok], y[ok]
            yield a, b, x, y, needed(self.size[x], self.size[y], *self.options)

    def places(self):
        """Some at a time: places a < b in the order of all pairs of a cell; those of a large cell tile by tile, so that few sets are in many pairs."""
        n = len(self.cell)
        starts = np.flatnonzero(np.diff(self.cell, prepend=-1))
        sizes = np.diff(starts, append=n)
        # rows of small cells, each with those after it
        many = np.repeat(np.where(sizes > TILE, 0, starts + sizes), sizes) - np.arange(n) - 1
        counts = np.cumsum(np.maximum(many, 0, out=many))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(counts, (counts[at - 1] if at else 0) + PAIRS, "right")))
            a = np.repeat(np.arange(at, to), many[at:to])
            yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to])
            at = to
        for start, size in zip(starts[sizes > TILE].tolist(), sizes[sizes > TILE].tolist(), strict=True):
            for i in range(start, start + size, TILE):
                for j in range(i, start + size, TILE):
                    a, b = (x.ravel() for x in np.meshgrid(np.arange(i, min(i + TILE, start + size)), np.arange(j, min(j + TILE, start + size)), indexing="ij"))
                    yield (a, b) if i < j else (a[a < b], b[a < b])

    def candidates(self):
        """Some at a time: pairs that meet here at the depth they need and in no tree before, and agree often enough; and the least depth needed by a row."""
        floor = least_agreement(self.trees * self.deepest, self.options[0])
        for a, b, x, y, need in self.pairs():
            meet = np.zeros(len(a), bool)
            for d in range(self.deepest, 0, -1):  # prefixes get shorter
                open_ = (need > 0) & (need <= d) & ~meet
                if not open_.any():
                    continue
                meet[open_] = self.nodes[d][a[open_]] == self.nodes[d][b[open_]]
            shared = need > 0
            stopped = x[shared], y[shared], need[shared]
            x, y, need = x[meet], y[meet], need[meet]
            for t in range(int(self.tree.max(initial=0))):
                later = self.tree[x] > t
                if later.any():
                    lcp = np.logical_and.accumulate(self.sketch[x[later], t] == self.sketch[y[later], t], axis=1).sum(axis=1)
                    first = np.ones(len(x), bool)
                    first[later] = lcp < need[later]
                    x, y, need = x[first], y[first], need[first]
            often = (self.sketch[x] == self.sketch[y]).sum(axis=(1, 2)) >= floor
            yield x[often], y[often], stopped


def join(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, class_id (smallest id of its near-copy component), copy_id (of its class of copies), n_links (rows linked to it), kept (whether it stands for its class), depth (prefix at which the forest stopped for it), text_sha256."""
    return _join(docs, **options).drop("row")


def _join(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 20, deepest: int = 8, recall: float = 0.999, cell: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``join`` returns, and the number of each row."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    rows = cut(sketches(narrow.withColumn("sha", F.sha2("t", 256)), n, trees, deepest))
    same = rows.where("set is not null").groupBy("set")
    copies = cut(same.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("members"), F.first("size").alias("size"), F.first("words").alias("words"), F.first("sketch").alias("sketch")))
    heads = copies.select("set", F.col("first.row").alias("head"), F.col("first.id").alias("head_id"), "members", "size", "words", "sketch")

    # subtrees of more than one row, at the shallowest depth that any pair can need
    shallowest = depth_for(threshold, trees, deepest, recall)
    prefix = lambda t: F.xxhash64(F.lit(t), F.substring("sketch", 1 + deepest * t, shallowest))
    forest = heads.select("head", "words", F.posexplode(F.array(*[prefix(t) for t in range(trees)])).alias("tree", "key"))
    crowds = forest.groupBy("key").agg(F.count("*").alias("n"), F.sum("words").alias("words")).where("n > 1")
    parts = lambda c, bound: F.ceil(F.greatest(F.sqrt(F.col(c) / bound), F.col(c) / (RATIO * bound)))
    crowds = crowds.select("key", F.greatest(parts("n", cell), parts("words", WORDS)).cast("int").alias("blocks"))
    placed = forest.drop("words").join(crowds, "key").withColumn("block", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int"))
    split = placed.select("key", "tree", "head", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    split = split.select("key", "tree", "head", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sketched = split.join(heads.select("head", "size", "sketch"), "head")
    together = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    options = threshold, trees, deepest, recall
    meets_schema = pa.schema([("key", pa.int64()), ("tree", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("head", pa.int64()), ("block", pa.int32()), ("depth", pa.int32()), ("meets", pa.bool_())])

    def meet(batches):
        for t in cells(batches, 2000):
            depth, meets = np.full(t.num_rows, deepest), np.zeros(t.num_rows, bool)
            for x, y, (a, b, need) in Subtrees(t, *options).candidates():
                meets[x] = meets[y] = True
                np.minimum.at(depth, a, need)
                np.minimum.at(depth, b, need)
            keep = pa.array(meets | (depth < deepest))
            yield from t.select(["key", "tree", "i", "j", "head", "block"]).append_column("depth", pa.array(depth)).append_column("meets", pa.array(meets)).filter(keep).cast(meets_schema).to_batches()

    met = cut(map_arrow(together(sketched), meet, "key long, tree int, i int, j int, head long, block int, depth int, meets boolean"))
    depths = met.groupBy("head").agg(F.min("depth").alias("depth"))

    # texts of classes that have pairs, in the cells that have them
    wanted = met.where("meets").drop("depth", "meets").join(heads.select("head", "members", "size", "sketch", "set"), "head")
    texts = wanted.join(narrow.select(F.col("row").alias("head"), "t"), "head")
    found_schema = pa.schema([("node", pa.int64()), ("to", pa.int64()), ("links", pa.int64())])

    def verify(batches):
        import xxhash

        for t in cells(batches, 200):
            sets = [shingles(x.as_py(), n) for x in t.column("t")]
            if any(xxhash.xxh3_128_hexdigest(own.tobytes()) != s for own, s in zip(sets, t.column("set").to_pylist(), strict=True)):
                raise RuntimeError("a row is not the one that was sketched: the plan of docs gave other rows when it ran again")
            node, members = t.column("head").to_numpy(), t.column("members").to_numpy()
            counts, root, out = np.zeros(len(sets), np.int64), list(range(len(sets))), []

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for x, y, _ in Subtrees(t, *options).candidates():
                linked = similar(sets, x, y, threshold)
                np.add.at(counts, x[linked], members[y[linked]])
                np.add.at(counts, y[linked], members[x[linked]])
                for k, m in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
                    a, b = find(k), find(m)
                    if a != b:
                        root[b] = a
                        out.append((node[k], node[m], None))
            out += [(node[k], None, counts[k]) for k in np.flatnonzero(counts)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), found_schema, strict=True)], schema=found_schema)

    found = cut(map_arrow(together(texts), verify, "node long, to long, links long"))
    linked = found.where("to is null").groupBy("node").agg(F.sum("links").alias("links"))
    near = components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    ids = heads.select(F.col("head").alias("root_row"), F.col("head_id").alias("root_id"))
    least_id = near.join(ids, F.col("node") == F.col("root_row")).groupBy("root").agg(F.min(F.struct(F.col("root_id").isNull().alias("none"), "root_id", "node")).alias("best"))
    classes = near.join(least_id, "root").select("node", F.col("best.root_id").alias("class_id"), F.col("best.node").alias("keeper"))
    per_head = cut(
        heads.join(classes, F.col("head") == F.col("node"), "left").drop("node")
        .join(linked, F.col("head") == F.col("node"), "left").drop("node")
        .join(depths.withColumnRenamed("head", "node"), F.col("head") == F.col("node"), "left")
        .select("set", "members", F.col("head_id").alias("copy_id"), F.when(F.col("keeper").isNull(), F.col("head_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("keeper", "head").alias("keeper"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), "depth")
    )
    alone = F.col("keeper").isNull()
    return attach(rows.select("id", "row", "sha", "set"), per_head, "set", "members").select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("row") == F.col("keeper"), F.lit(True)).alias("kept"), F.coalesce("depth", F.lit(deepest)).cast("long").alias("depth"), F.col("sha").alias("text_sha256"), "row",
    )


def similar(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs are linked, by exact sizes of intersections: by a matrix product where pairs are many, else one by one."""
    out = np.zeros(len(x), bool)
    touched = np.unique(np.concatenate([x, y]))
    if len(x) > DENSE * len(touched) and len(touched) <= 1024:
        links = compare([sets[k] for k in touched], threshold)
        return links[np.searchsorted(touched, x), np.searchsorted(touched, y)]
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        one, two = sets[a], sets[b]
        at = np.searchsorted(one, two)
        common = int((one[np.minimum(at, len(one) - 1)] == two).sum())
        out[k] = common >= threshold * (len(one) + len(two) - common) - 1e-9
    return out


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stand for their near-copy class; further rows of the id and text of one that stays go like other copies."""
    return by_row(docs, _join(docs, **options).where("kept").select("row", F.col("text_sha256").alias("sha")), F.coalesce(F.col("__row.text"), F.lit("")))
