"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Lexicon: from a bounded sample of labelled training rows (``SAMPLE``), the words that
stand in toxic documents far beyond chance, by a binomial test over the vocabulary.
Occurrences count once per distinct neighbourhood, so that copies of one document
prove nothing. Matching: a Levenshtein automaton of the input is run against the trie
of the lexicon; their product is made deterministic as inputs come, so a word costs
one step a letter and dies with its second wrong letter. Terms of five letters or more
match within one edit. Beginnings of words (``STEMS`` letters) are tested like words; those
that pass stand in the trie with an open end, so inflected forms never seen match too; the
terms that they cover stand beside them, so that an error in the beginning is found too. Context: each match has a window; quotation marks around it and
reporting words in it tell quoting from abuse. A logistic model over the matches of
the sample gives the score.

The sample and what is learned from it are the only things sent around. The lexicon holds
every term that passes the test, so the sample alone bounds it: a term needs some
distinct toxic neighbourhoods of its own in those rows.
Scoring is one pass over all whole texts without a shuffle.

Defined cases: null and empty texts get the score of a text without matches; without
toxic labels the score is 0 everywhere; ids may be null or repeat; labels of a
document that disagree count as toxic; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argloom.llm.util import Remembered, cut, map_arrow

#: At most so many labelled rows are learned from.
SAMPLE = 20_000
#: Lengths of word beginnings tested, what ends the name of one, and the share of toxic places and the number of different words that one needs.
STEMS, OPEN = (4, 5, 6), "*"
STEM_SHARE, STEM_WORDS = 0.998, 3
TOKEN = re.compile(r"\w+")
#: Letters around a match that form its window.
WINDOW = 60
#: Words that report speech.
REPORTS = frozenset("said says wrote called quote quoted quotes dit écrit appelé dijo escribió llamó sagte schrieb nannte".split())
QUOTES = '"“”«»„'


class LexiconAutomaton:
    """Product of the trie of terms and the Levenshtein automaton, made deterministic as needed."""

    def __init__(self, terms: list[str], edits: int = 1, shortest: int = 5, most_states: int = 50_000):
        self.terms, self.edits, self.shortest, self.most = terms, edits, shortest, most_states
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.open: dict[int, int] = {}
        for k, t in enumerate(terms):
            node = 0
            for c in t.rstrip(OPEN):
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                node = nxt
            if t.endswith(OPEN):
                self.open[node] = k
            else:
                self.term[node] = k
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[frozenset, int] = {frozenset(): 0}
        self.sets, self.steps, self.accepts, self.opened = [frozenset()], [{}], [None], [None]
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """Number of the state, with letters of terms skipped (missing in the input) added."""
        todo, best = list(pairs), {}
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) > e:
                best[node] = e
                if e < self.edits:
                    todo += [(c, e + 1) for c in self.children[node].values()]
        key = frozenset(best.items())
        got = self.numbers.get(key)
        if got is None:
            got = self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, self.term[n]) for n, e in best.items() if self.term[n] >= 0 and (not e or len(self.terms[self.term[n]]) >= self.shortest)]
            self.accepts.append(min(ends, default=None))
            self.opened.append(next(((0, self.open[n]) for n, e in best.items() if not e and n in self.open), None))
        return got

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of the nearest term within reach."""
        state = self.start
        for c in word:
            nxt = self.steps[state].get(c)
            if nxt is None:
                pairs = set()
                for node, e in self.sets[state]:
                    child = self.children[node].get(c)
                    if child is not None:
                        pairs.add((child, e))
                    if e < self.edits:
                        pairs.add((node, e + 1))
                        pairs |= {(n, e + 1) for n in self.children[node].values()}
                if len(self.sets) > self.most:
                    self._clear()
                    return self.match(word)
                nxt = self._state(pairs) if pairs else 0
                self.steps[state][c] = nxt
            if not nxt:
                return None
            state = nxt
            if self.opened[state]:
                return self.opened[state]
        return self.accepts[state]


class Scorer:
    """Matches of texts, and their features."""

    def __init__(self, lexicon: list[tuple[str, float]]):
        self.strength = [w for _, w in lexicon]
        self.automaton = LexiconAutomaton([t for t, _ in lexicon])
        self.known = Remembered(self._match)

    def _match(self, word: str):
        return self.automaton.match(word) or False

    def features(self, text: str | None) -> tuple[float, ...]:
        """Exact, misspelled and quoted matches (1 - 2^-count), strongest exact term, share of words that match."""
        low = (text or "").lower()
        words = TOKEN.findall(low)
        known = self.known
        if not any(map(known.__getitem__, words)):
            return (0.0,) * 5
        exact = near = quoted = 0
        strongest = 0.0
        for m in TOKEN.finditer(low):
            got = known[m.group()]
            if got:
                before, after = low[max(0, m.start() - WINDOW) : m.start()], low[m.end() : m.end() + WINDOW]
                marks = sum(map(before.rpartition("\n")[2].count, QUOTES)), sum(map(after.partition("\n")[0].count, QUOTES))
                if marks[0] % 2 and marks[1] or REPORTS & set(TOKEN.findall(before)):
                    quoted += 1
                elif got[0]:
                    near += 1
                else:
                    exact += 1
                    strongest = max(strongest, self.strength[got[1]])
        soft = lambda n: 1 - 0.5**n
        return soft(exact), soft(near), soft(quoted), strongest, (exact + near + quoted) / len(words)


def forms(word: str) -> list[str]:
    """The word and its beginnings with an open end."""
    return [word, *(word[:k] + OPEN for k in STEMS if len(word) >= k)]


def in_training(doc_id: int | None) -> bool:
    """Whether labels of this document may be learned from."""
    return zlib.crc32(str(doc_id).encode()) % 3 != 1


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def training(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of the sample: the labelled training rows that come first in a seeded order."""
    judged = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("of"), "toxic")
    return cut(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("text", "toxic"))  # at most ``sample`` rows of 12 bytes


def learn_lexicon(train: DataFrame, terms: int | None = None) -> list[tuple[str, float]]:
    """(term, strength in 0 to 1) of words that mark toxic texts, all of them unless a caller asks for the first few only (those under a stem come besides)."""
    seen_schema = pa.schema([("word", pa.string()), ("bad", pa.int64()), ("n", pa.int64())])

    def seen(batches):
        for b in batches:
            bad, n = Counter(), Counter()
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = {f for w in set(TOKEN.findall((text or "").lower())) for f in forms(w)}
                n.update(words)
                if toxic:
                    bad.update(words)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array([bad[w] for w in n], pa.int64()), pa.array(n.values(), pa.int64())], schema=seen_schema)

    totals = train.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    if not totals.bad:
        return []
    words = map_arrow(train, seen, "word string, bad long, n long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    base = totals.bad / totals.n
    rows = cut(words.where("n >= 2"))
    tried = rows.count()
    picked = rows.where((F.col("bad") >= 3) & (F.col("bad") / F.col("n") >= max(0.5, 2 * base))).select("word").collect()  # of the sample's words
    candidates = {r.word for r in picked}
    around_schema = pa.schema([("word", pa.string()), ("around", pa.int64()), ("toxic", pa.int32()), ("form", pa.int64())])

    def around(batches):
        for b in batches:
            out = set()
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = TOKEN.findall((text or "").lower())
                for i, f in ((i, f) for i, w in enumerate(words) for f in forms(w) if f in candidates):
                    out.add((f, zlib.crc32(" ".join(words[max(0, i - 1) : i] + words[i : i + 2]).encode()), toxic, zlib.crc32(words[i].encode())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, around_schema, strict=True)], schema=around_schema)

    places = map_arrow(train, around, "word string, around long, toxic int, form long").distinct()
    chosen = []
    for r in places.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"), F.count_distinct("form").alias("forms")).collect():  # a row a candidate
        share = r.bad / r.n
        if share >= max(0.5, 2 * base):
            gain = r.n * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0))
            if gain > math.log(max(tried, 2) / 0.05):  # Chernoff bound of the binomial tail, over all words tried
                chosen.append((-gain, r.word, share, r.forms))
    stems = {w.rstrip(OPEN) for _, w, s, forms_ in chosen if w.endswith(OPEN) and s >= STEM_SHARE and forms_ >= STEM_WORDS}
    shorter = lambda w: any(w[:k] in stems for k in STEMS if k < len(w))
    kept = [(w, s) for _, w, s, _ in sorted(chosen) if (w.rstrip(OPEN) in stems if w.endswith(OPEN) else w not in stems) and not shorter(w.rstrip(OPEN))]
    kept = kept[:terms]
    stems &= {w.rstrip(OPEN) for w, _ in kept if w.endswith(OPEN)}
    # terms under a stem stand for their misspellings
    return kept + [(w, s) for _, w, s, _ in sorted(chosen) if not w.endswith(OPEN) and any(w[:k] in stems for k in STEMS)]


def fit(features: np.ndarray, toxic: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic model, the constant first, by Newton's method."""
    x = np.hstack([np.ones((len(features), 1)), features])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (toxic - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


FEATURES = 5


def features_of(frame: DataFrame, lexicon: list[tuple[str, float]], weights: list[float] | None = None) -> DataFrame:
    """(key, array of features) of (key, text), or with weights (key, score)."""
    kind = pa.float64() if weights else pa.list_(pa.float64())
    schema = pa.schema([("key", pa.int64()), ("value", kind)])

    def run(batches):
        scorer = Scorer(lexicon)
        for b in batches:
            found = map(scorer.features, b.column(1).to_pylist())
            values = [1 / (1 + math.exp(-max(-30.0, min(30.0, weights[0] + sum(w * x for w, x in zip(weights[1:], f, strict=True)))))) for f in found] if weights else [list(f) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, kind)], schema=schema)

    return map_arrow(frame, run, "key long, value " + ("double" if weights else "array<double>"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[str, float]], list[float]] | None:
    """Lexicon and weights; None if there is nothing to learn from."""
    train = training(docs, labels, sample)
    lexicon = learn_lexicon(train)
    rows = features_of(train.select(F.col("toxic").cast("long"), "text"), lexicon).collect()  # at most ``sample`` rows
    toxic = np.array([r.key for r in rows], float)
    if not toxic.any() or not lexicon:
        return None
    return lexicon, fit(np.array([r.value for r in rows]), toxic).tolist()


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, sample)
    if model is None:
        scored = docs.select(F.col("doc_id").cast("long").alias("key"), F.lit(0.0).alias("value"))
    else:
        scored = features_of(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), *model)
    named = scored.select(F.col("key").alias("doc_id"), F.col("value").alias("score"))
    return named.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score below the threshold, decided row by row without a join."""
    model = learn(docs, labels, sample)
    if model is None:
        return docs
    lexicon, weights = model
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        scorer = Scorer(lexicon)
        for b in batches:
            f = np.array([scorer.features(t) for t in b.column(at).to_pylist()]).reshape(-1, FEATURES)
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(weights[0] + f @ np.array(weights[1:]), -30, 30))) < threshold))

    return map_arrow(docs, run, schema)
