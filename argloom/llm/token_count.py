"""Token counts by heap-and-linked-list byte-pair merging, without identifiers.

The vocabulary is that of a SentencePiece BPE model with byte fallback, no text
normalisation and a leading word mark. Symbols of a text are its code points in a
doubly linked list; a heap holds adjacent pairs that form a piece, best score and then
leftmost first. Popping the best pair again and again, the count is initial symbols
minus merges; a code point that no piece covers counts its UTF-8 bytes instead.

Merges cannot cross a place where no piece has the two neighbours in a row, so a text
is cut there: before the word mark (pieces hold it only in front) and around line
feeds. Counts of units are remembered in a bounded dictionary per task.

Defined cases: null and empty texts have 0 tokens and 0 bytes; ids may be null or
repeat; other columns are not looked at. Texts are taken whole; one pass, no shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.llm.util import Remembered, map_arrow

MARK = "▁"


class PairMerger:
    """Counts tokens of texts under one vocabulary."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece has the word mark inside")
        self.lines = not any("\n" in p for p in scores)
        self.first, self.later = Remembered(self.merged), Remembered(lambda unit: self.merged(MARK + unit))

    def merged(self, text: str) -> int:
        """Initial symbols minus merges of a unit."""
        scores, n = self.scores, len(text)
        if n == 1 or text in scores and n == 2:
            return 1 if text in scores else len(text.encode())
        symbols: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-scores[p], i, p) for i in range(n - 1) if (p := text[i : i + 2]) in scores]
        heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heappop(heap)
            left, j = symbols[i], after[i]
            if left is None or j < 0 or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue  # one side has merged meanwhile
            merges += 1
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (p := pair + symbols[k]) in scores:
                    heappush(heap, (-scores[p], i, p))
            h = before[i]
            if h >= 0 and (p := symbols[h] + pair) in scores:
                heappush(heap, (-scores[p], h, p))
        return n - merges + sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in scores)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        first, later, total = self.first, self.later, 0
        for k, line in enumerate(text.split("\n") if self.lines else [text]):
            total += k > 0  # the line feed itself, one byte
            if "  " in line or line[-1:] == " ":
                for unit in re.findall(" *[^ ]+| +", line if k else " " + line):
                    total += first[unit.replace(" ", MARK)]
                continue
            words = line.split(" ")
            if k:  # only the text's own start has a word mark added
                total += first[words[0]] if words[0] else 0
                words = words[1:]
            elif not words[0]:  # a blank before the first word: two marks in a row
                total += first[MARK] if len(words) < 2 else first[MARK * 2 + words[1]]
                words = words[2:]
            total += sum(map(later.__getitem__, words))
        return total


@lru_cache(maxsize=2)
def merger(model_path: str) -> PairMerger:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ordinary = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return PairMerger({sp.id_to_piece(i): sp.get_score(i) for i in ordinary})


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. ``model_path`` is a file that every executor has."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        count = merger(model_path).count
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    return map_arrow(narrow, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
