"""Substring dedup with repeated-phrase automata.

A window is ``length`` consecutive words of one document; windows that start in two
places are repeated, and every word one of them covers is removed.

1. Phrases. Each window has an anchor: the least hash of the word n-grams in it. Equal
   windows have equal anchors, and about one n-gram in ten is an anchor. A fingerprint
   exchange (``exchange``) tells each block which of its anchors recur anywhere.
2. Confirmation. Windows under recurring anchors are exchanged by 96-bit keys, which
   tells each block which of its windows recur, at the edges of passages too.
3. Location. Each block lays its confirmed passages out in phrases of ``length`` words,
   compiles them into Aho-Corasick automata (in shards of bounded size) and streams its
   documents through them; every occurrence found is removed.

Blocks hold documents by hash of id and row number. What moves: the texts once, anchors, keys of
windows in repeated regions, and bitmaps. A passage in thousands of documents costs an
owner one entry a block.

Defined cases: a null or empty text has no words (n_words 0, digest of the empty
string); texts shorter than a window lose nothing; repeated rows are documents of their
own, so their windows repeat; ids may be null; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.llm import exchange
from argloom.llm.util import ship, tasks

U64 = np.uint64
#: Phrases in one automaton, and words hashed at a time.
SHARD, CHUNK = 8_000, 1_000_000
#: Letters that a word's number has in an automaton: 2^30 different words a block.
LETTERS = 5
ODD = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolled(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every k values in a row, by doubling; as many results as there are starts."""
    out, width, done, got = h, 1, 0, None
    power = int(base)
    while True:
        if k & width:
            if got is None:
                got, done = out, width
            else:
                n = len(h) - done - width + 1
                got = out[:n] * U64(pow(int(base), done, 1 << 64)) + got[width : width + n]
                done += width
        if done == k:
            return mixed(got)
        n = len(out) - width
        out = out[:n] * U64(power) + out[width : width + n]
        power = power * power % (1 << 64)
        width *= 2


def sliding(x: np.ndarray, k: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of every k values in a row."""
    out, width = x, 1
    while width < k:
        step = min(width, k - width)
        out = least(out[: len(out) - step], out[step:])
        width += step
    return out


class _Words(dict):
    """Numbers words as they come, with their hashes."""

    def __init__(self):
        import xxhash

        self.of, self.hashes = xxhash.xxh3_64_intdigest, []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(self.of(word))
        return n


class Block:
    """The documents of a block as numbers of words, and their windows."""

    def __init__(self, texts: list[bytes | None], length: int):
        self.length, self.gram = length, max(1, (length + 1) // 2)
        self.words = _Words()
        self.docs = [np.fromiter(map(self.words.__getitem__, w), np.uint32, len(w)) for w in ((t or b"").split() for t in texts)]
        self.hashes = np.array(self.words.hashes, U64)

    def chunks(self):
        """Documents with a window, some at a time: (their numbers, hashes in a row, start of each)."""
        long = [i for i, d in enumerate(self.docs) if len(d) >= self.length]
        while long:
            take, size = 0, 0
            while take < len(long) and (not take or size + len(self.docs[long[take]]) <= CHUNK):
                size += len(self.docs[long[take]])
                take += 1
            some, long = long[:take], long[take:]
            sizes = np.array([len(self.docs[i]) for i in some])
            yield some, self.hashes[np.concatenate([self.docs[i] for i in some])], np.cumsum(sizes) - sizes, sizes

    def windows(self):
        """Per chunk: document and start of each window, its anchor, hashes of the chunk, starts in the chunk, and the anchors chosen."""
        for some, h, starts, sizes in self.chunks():
            doc = np.repeat(np.arange(len(some)), sizes)
            valid = doc[: len(h) - self.length + 1] == doc[self.length - 1 :]
            grams = rolled(h, self.gram, ODD[0])
            span = self.length - self.gram + 1
            anchor = sliding(grams, span, np.minimum)[: len(valid)]
            best = np.where(valid, anchor, U64(0))
            padded = np.concatenate([np.zeros(span - 1, U64), best, np.zeros(span - 1, U64)])
            most = sliding(padded, span, np.maximum)[: len(grams)]
            at = np.flatnonzero(valid)
            yield np.array(some)[doc[at]], at - starts[doc[at]], anchor[at], h, at, grams[grams == most]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        chosen = [w[5] for w in self.windows()]
        values, counts = np.unique(np.concatenate(chosen), return_counts=True) if chosen else (np.zeros(0, U64), np.zeros(0, int))
        return values, counts > 1

    def keys(self, recurring: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct 96-bit keys of windows under recurring anchors, sorted: high, low, twice here; then document, start and number of key of each such window."""
        docs, starts, high, low = [], [], [], []
        for doc, start, anchor, h, at, _ in self.windows():
            if len(recurring):
                hit = recurring[np.minimum(np.searchsorted(recurring, anchor), len(recurring) - 1)] == anchor
                docs.append(doc[hit])
                starts.append(start[hit])
                high.append(rolled(h, self.length, ODD[1])[at[hit]])
                low.append((rolled(h, self.length, ODD[2])[at[hit]] >> U64(32)).astype(np.uint32))
        if not docs:
            return (np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(3)))
        doc, start, a, b = map(np.concatenate, (docs, starts, high, low))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        number = np.cumsum(new) - 1
        return a[new], b[new], np.bincount(number) > 1, doc[order], start[order], number

    def phrases(self, doc: np.ndarray, start: np.ndarray) -> list[str]:
        """Confirmed passages, laid out in phrases of the window's length, each once."""
        if not len(doc):
            return []
        order = np.lexsort((start, doc))
        doc, start, out = doc[order], start[order], set()
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + self.length)]))
        for a, b in zip(first, [*first[1:], len(doc)], strict=True):
            text, at, k = self.coded(doc[a]), start[a:b], 0
            while True:  # the furthest window that leaves no gap
                out.add(text[LETTERS * at[k] : LETTERS * (at[k] + self.length)])
                if k == len(at) - 1:
                    break
                k = np.searchsorted(at, at[k] + self.length, "right") - 1
        return sorted(out)

    def coded(self, i: int) -> str:
        """A document with each word's number in LETTERS letters out of 64."""
        if len(self.words) > 64**LETTERS:
            raise OverflowError("a block has more different words than their letters can tell apart: use more shuffle partitions")
        d = self.docs[i]
        letters = np.empty((len(d), LETTERS), np.uint8)
        for k in range(LETTERS):
            letters[:, k] = (d >> (6 * (LETTERS - 1 - k)) & 63) + 48
        return letters.tobytes().decode("ascii")

    def covered(self, phrases: list[str]) -> list[np.ndarray | None]:
        """Per document, which words an occurrence of a phrase covers."""
        import ahocorasick

        steps: list[np.ndarray | None] = [None] * len(self.docs)
        for k in range(0, len(phrases), SHARD):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in phrases[k : k + SHARD]:
                automaton.add_word(p)
            automaton.make_automaton()
            for i, d in enumerate(self.docs):
                if len(d) >= self.length:
                    ends = [(e + 1) // LETTERS for e, _ in automaton.iter(self.coded(i)) if (e + 1) % LETTERS == 0]
                    if ends:
                        step = steps[i] = np.zeros(len(d) + 1, np.int32) if steps[i] is None else steps[i]
                        np.add.at(step, np.array(ends) - self.length, 1)
                        np.add.at(step, ends, -1)
        return [None if s is None else np.cumsum(s[:-1]) > 0 for s in steps]


def remove_repeats(docs: DataFrame, length: int = 35, doc_id: str = "doc_id", text: str = "text", texts_too: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and with texts_too the kept words joined by spaces as kept_text."""
    spark = docs.sparkSession
    ship(spark)
    owners = tasks(spark)
    # by number in the partition too, so that rows of one id, or of none, are dealt out
    key = F.pmod(F.xxhash64(F.col(doc_id), F.monotonically_increasing_id()), F.lit(owners))
    blocks = docs.select(key.alias("block"), F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    by_block = lambda df: df.groupBy("block")

    def read(rows: pa.Table) -> Block:
        return Block(rows.column("t").to_pylist(), length)

    def send_anchors(rows: pa.Table) -> pa.Table:
        values, again = read(rows).anchors()
        return exchange.table(exchange.messages(1, rows.column("block")[0].as_py(), owners, values, again))

    def send_windows(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return exchange.table([])
        block = read(rows)
        anchors, _ = block.anchors()
        high, low, again, *_ = block.keys(anchors[exchange.flags_of(bitmaps, 1, anchors, owners)])
        return exchange.table(exchange.messages(2, rows.column("block")[0].as_py(), owners, high, again, low))

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept_text", pa.string())] * texts_too)

    def locate(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return exchange.table([], schema)
        block = read(rows)
        anchors, _ = block.anchors()
        high, _, _, doc, start, number = block.keys(anchors[exchange.flags_of(bitmaps, 1, anchors, owners)])
        hit = exchange.flags_of(bitmaps, 2, high, owners)[number] if len(high) else np.zeros(0, bool)
        removed = block.covered(block.phrases(doc[hit], start[hit]))
        out = []
        for i, t, gone in zip(rows.column("id").to_pylist(), rows.column("t").to_pylist(), removed, strict=True):
            words = (t or b"").split()
            kept = words if gone is None else [w for w, g in zip(words, gone, strict=True) if not g]
            left = b" ".join(kept)
            out.append((i, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), *[left.decode("utf-8", "replace")] * texts_too))
        return exchange.table(out, schema)

    bitmaps = exchange.answers(by_block(blocks).applyInArrow(send_anchors, exchange.MESSAGE))
    more = exchange.answers(by_block(blocks).cogroup(by_block(bitmaps)).applyInArrow(send_windows, exchange.MESSAGE))
    return by_block(blocks).cogroup(by_block(bitmaps.unionByName(more))).applyInArrow(locate, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts_too)
