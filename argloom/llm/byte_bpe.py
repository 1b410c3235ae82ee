"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the tokenizer's pattern; the bytes of each match are merged by rank.
Every merge rank has a bucket of linked-list positions. Three bitmaps of 64-way words
tell which buckets hold entries: find-first-set from the top word down gives the
lowest rank in a constant number of steps, whatever the length of the match. Entries
whose pair has changed meanwhile are stale and skipped. A bucket's positions go from
left to right; if a merge makes a pair of a lower rank, the rest of the bucket waits.

Matches not seen before are merged many at a time: their bytes stand one after the
other in one linked list without a pair across a border, so each match is merged as it
would be alone, and a rank is looked for once for all of them. The first ranks come
from a table of byte pairs. Of a bucket with entries of many matches, the leftmost of
each match are merged at once, as matches do not touch one another; other buckets, as
those of one long match, entry by entry. n bytes take O(n log n) at worst and O(n) memory.

Ids of short matches are remembered per worker in a bounded dictionary; long ones are
not. ``LETTERS`` bounds the texts that are held as matches at a time (a longer text is
taken alone).

Defined cases: null and empty texts have no ids (digests are those of the empty
string); ids of rows may be null or repeat; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.llm.util import map_arrow


#: Letters of texts cut at a time, matches remembered in each of two generations, and the letters of the longest that is.
LETTERS, REMEMBERED, LONGEST = 1 << 20, 250_000, 32
#: Entries from which on a bucket is merged at once; only the time depends on it.
MANY = 48


class ByteBpe:
    """One tokenizer. The queue's bitmaps and buckets are empty between calls."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks, self.pieces, self.size = ranks, {r: b for b, r in ranks.items()}, max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([i])] for i in range(256)])
        self.couples = np.array([ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)])
        # rank of the piece that two ids form, by first id * size + second id: every cut of every piece
        self.pairs = {ranks[p[:k]] * self.size + ranks[p[k:]]: r for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks}
        self.pair_keys = np.sort(np.fromiter(self.pairs, np.int64, len(self.pairs)))
        self.pair_ranks = np.fromiter(map(self.pairs.__getitem__, self.pair_keys.tolist()), np.int64, len(self.pairs))
        self.words, self.groups, self.top = [0] * (self.size + 64 >> 6), [0] * (self.size + 4096 >> 12), 0
        self.buckets: dict[int, list[int]] = {}
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def _mark(self, rank: int) -> None:
        word = rank >> 6
        self.words[word] |= 1 << (rank & 63)
        self.groups[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def _lowest(self) -> int:
        """The lowest rank that has a bucket, found first-set by first-set, and unmarked; -1 if there is none."""
        top, groups, words = self.top, self.groups, self.words
        if not top:
            return -1
        group = (top & -top).bit_length() - 1
        x = groups[group]
        word = (group << 6) + (x & -x).bit_length() - 1
        y = words[word]
        rank = (word << 6) + (y & -y).bit_length() - 1
        words[word] = y = y & (y - 1)
        if not y:
            groups[group] = x = x & (x - 1)
            if not x:
                self.top = top & (top - 1)
        return rank

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it forms no piece."""
        if not len(self.pair_keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def _push(self, ranks: np.ndarray, at: np.ndarray) -> None:
        buckets, mark, some = self.buckets, self._mark, ranks >= 0
        for r, i in zip(ranks[some].tolist(), at[some].tolist(), strict=True):
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                mark(r)

    def merge(self, matches: list[bytes]) -> list[list[int]]:
        """Ids of each match (none of them empty)."""
        sizes = np.fromiter(map(len, matches), np.int64, len(matches))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(matches), np.uint8).astype(np.int64)
        n = len(data)
        if not n:
            return []
        rank_of = np.full(n, -1)
        rank_of[:-1] = self.couples[data[:-1] << 8 | data[1:]]
        rank_of[ends - 1] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = before[ends - sizes] = -1
        at = np.flatnonzero(rank_of >= 0)
        at = at[np.argsort(rank_of[at], kind="stable")]
        starts = np.flatnonzero(np.diff(rank_of[at], prepend=-1))
        pair, size, buckets, mark = self.pairs.get, self.size, self.buckets, self._mark
        for rank, bucket in zip(rank_of[at[starts]].tolist(), np.split(at, starts[1:]) if len(at) else [], strict=True):
            buckets[rank] = bucket.tolist()
            mark(rank)
        all_ids, owner = self.single[data], np.repeat(np.arange(len(matches)), sizes)
        # the same memory, for single entries and for many at once
        after_of, before_of = after, before
        ids, rank_at, after, before = map(memoryview, (all_ids, rank_of, after_of, before_of))
        while (rank := self._lowest()) >= 0:
            bucket = buckets.pop(rank)
            bucket.sort()  # nearly sorted as it is
            if len(bucket) >= MANY:
                at = np.array(bucket)
                at = at[rank_of[at] == rank]
                first = np.diff(owner[at], prepend=-1) > 0
                i = at[first]
                if 2 * len(i) >= len(bucket):
                    # the leftmost of each match at once; further ones of a match wait
                    if len(i) < len(at):
                        buckets[rank] = at[~first].tolist()
                        mark(rank)
                    j = after_of[i]
                    far, near = after_of[j], before_of[i]
                    all_ids[i], all_ids[j], rank_of[j], after_of[i] = rank, -1, -1, far
                    more, less = far >= 0, near >= 0
                    before_of[far[more]], near = i[more], near[less]
                    right = np.full(len(i), -1)
                    right[more] = self._ranks(rank * size + all_ids[far[more]])
                    left = self._ranks(all_ids[near] * size + rank)
                    rank_of[i], rank_of[near] = right, left
                    self._push(right, i)
                    self._push(left, near)
                    continue
            for k, i in enumerate(bucket):
                if rank_at[i] != rank:
                    continue  # stale
                j = after[i]
                ids[i], ids[j], rank_at[j], lower = rank, -1, -1, False
                far, near = after[j], before[i]
                after[i] = far
                if far >= 0:
                    before[far] = i
                    r = rank_at[i] = pair(rank * size + ids[far], -1)
                    if r >= 0:
                        lower = r < rank
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            mark(r)
                else:
                    rank_at[i] = -1
                if near >= 0:
                    r = rank_at[near] = pair(ids[near] * size + rank, -1)
                    if r >= 0:
                        lower = lower or r < rank
                        if r in buckets:
                            buckets[r].append(near)
                        else:
                            buckets[r] = [near]
                            mark(r)
                if lower and k + 1 < len(bucket):
                    buckets[rank] = bucket[k + 1 :]
                    mark(rank)
                    break
        stays = all_ids >= 0
        left = np.concatenate([[0], np.cumsum(stays)])[ends].tolist()
        ids = all_ids[stays].tolist()
        whole = self.ranks.get  # a match that is a piece stands for itself, whether merges lead to it or not
        return [ids[a:b] if (r := whole(m)) is None else [r] for m, a, b in zip(matches, [0, *left], left)]

    def encode(self, text: str | None) -> list[int]:
        found = self.find(text or "")
        distinct = list(dict.fromkeys(found))
        of = dict(zip(distinct, self.merge([m.encode() for m in distinct]), strict=True))
        return [i for m in found for i in of[m]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids in decimal, SHA-256 of what they decode to."""
        out, some, letters = [], [], 0
        for t in texts:
            some.append(t or "")
            letters += len(some[-1])
            if letters >= LETTERS:
                out += self._digests(some)
                some, letters = [], 0
        return out + self._digests(some)

    def _digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        found = [self.find(t) for t in texts]
        distinct = set().union(*found)
        here = {m: got for m in distinct if (got := self.known.get(m) or self.older.get(m))}
        new = [m for m in distinct if m not in here]
        for m, ids in zip(new, self.merge([m.encode() for m in new]), strict=True):
            here[m] = ",".join(map(str, ids)), self.decode(ids)
        fresh = {m: got for m, got in here.items() if len(m) <= LONGEST and m not in self.known}
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, self.older = {}, self.known
        self.known.update(islice(fresh.items(), REMEMBERED))
        out = []
        for f in found:
            parts = [*map(here.__getitem__, f)]
            ids = ",".join([p[0] for p in parts])
            out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([p[1] for p in parts])).hexdigest()))
        return out


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> ByteBpe:
    with open(ranks_path, "rb") as lines:  # a tokenizer file that every executor has
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        of = coder(ranks_path, pattern).encode
        for b in batches:
            for k in range(0, b.num_rows, 256):  # ids take more room than texts
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([of(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], schema=schema)

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of what ``encode`` returns."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])

    def run(batches):
        of = coder(ranks_path, pattern).decode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(x or []) for x in b.column(1).to_pylist()], pa.binary())], schema=schema)

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, content binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded and decoded in one pass, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        of = coder(ranks_path, pattern).digests
        for b in batches:
            n, ids, back = zip(*of(b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], schema=schema)

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
