"""Quality rules with risk-controlled thresholds.

Counts of a text give ratios (symbols, duplicate lines, repeated words, capitals, word
length). For each stratum one sequence of joint cutoffs, from lax to strict, is fixed on
a part of the labelled documents (``in_grid``): the STEPS quantiles of each ratio among
good ones. On the rest, the holdout, the sequence is walked: at each step the documents
that any rule rejects are counted together, and the step is certified if the exact
(Clopper-Pearson) binomial upper bound of the share of good documents rejected is no
more than ``limit``. The walk ends at the first step that is not, so the fixed order
needs no correction for the steps; over strata the level is divided (Bonferroni). Of the
certified steps, the first that rejects the most bad documents is taken. So with
probability 1 - ``error``, in every stratum all rules together reject at most ``limit``
of the good documents that the base rule leaves. A stratum with too few labels gets no
cutoffs and loses nothing: with none rejected, n good ones of s strata support a limit
of 1 - (error / s) ** (1 / n), so 0.03 takes 121 of each of 4 strata at 0.1.

The bound needs documents that are drawn apart, so of near copies (those that share the
least hash of their 3-word windows) one counts, the least id. Labels are joined to
counts, never to texts; quantiles and histograms (stratum x label x step) reach the
driver: strata are languages, so these stay small.

Defined cases: a null text has no words and fails the base rule; a null language is a
stratum of its own; several labels of one document count as the worst; unlabelled
documents only get a verdict; an empty label table gives no cutoffs; repeated rows are
decided alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.llm.util import cut, map_arrow

SYMBOLS = "#*$%&|<>"
CAPITALS = bytes(range(65, 91))
RATIOS = ("symbols", "dup_lines", "repeats", "capitals", "word_length")
#: Quantiles among good documents, each times a factor, from lax to strict.
STEPS = ((1.0, 2.0), (1.0, 1.0), (0.995, 1.0), (0.99, 1.0), (0.98, 1.0), (0.97, 1.0), (0.95, 1.0))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 10_000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + up / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * f


def upper_bound(k: int, n: int, level: float) -> float:
    """The largest share under which k or fewer of n still has probability ``level``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - incomplete_beta(k + 1, n - k, mid) > level else (low, mid)
    return high


def counts_of(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines with a word, n_capitals, and the least hash of 3-word windows."""
    if not text:
        return (0,) * 8
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.split()]
    repeats = least = 0
    if n > 3:
        number: dict[bytes, int] = {}
        w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, n)
        v = len(number)
        pairs = np.unique(w[:-1] * v + w[1:], return_inverse=True)[1]  # numbered anew, so that no product is too large
        _, at, times = np.unique(pairs[:-1] * v + w[2:], return_inverse=True, return_counts=True)
        own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in number), np.uint64, v)[w]
        mixed = ((own[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ own[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) ^ own[2:]) * np.uint64(0x94D049BB133111EB)
        least = int((mixed ^ (mixed >> np.uint64(32))).min() >> np.uint64(1))
        twice = times[at] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeats = int(covered.sum())
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), len(raw) - len(raw.translate(None, CAPITALS)), least


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "least_window")


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *((n, pa.int64()) for n in NAMES)])

    def run(batches):
        for b in batches:
            columns = zip(*map(counts_of, b.column(2).to_pylist()), strict=True) if b.num_rows else [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in columns)], schema=schema)

    narrow = docs.select(F.col(doc_id).cast("long").alias("a"), F.col(stratum).cast("string").alias("b"), F.col(text).alias("c"))
    return map_arrow(narrow, run, "doc_id long, stratum string, " + ", ".join(f"{n} long" for n in NAMES))


def ratios() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"),
        "capitals": per("n_capitals", "word_chars"), "word_length": per("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def in_grid() -> Column:
    """Whether a labelled document serves to lay the cutoffs out; the others are the holdout."""
    return F.crc32(F.concat(F.lit("grid:"), F.col("doc_id").cast("string")).cast("binary")) % 7 == 0


def stratum_key() -> Column:
    """The stratum as a key that is never null."""
    return F.when(F.col("stratum").isNull(), "none").otherwise(F.concat(F.lit("of "), "stratum"))


def first_step(cutoffs: dict[str, dict[str, list[float]]]) -> Column:
    """The first step at which any rule of the row's stratum rejects it; as many as there are steps if none does."""
    step = F.lit(len(STEPS))
    for name, value in ratios().items():
        table = [F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for key, of in sorted(cutoffs.items()) for x in (key, of[name])]
        if table:
            laxer = F.size(F.filter(F.element_at(F.create_map(*table), stratum_key()), lambda c: value <= c))  # cutoffs never rise along the steps  # noqa: B023
            step = F.least(step, F.when(laxer >= 0, laxer))
    return step


def chosen_steps(counted: DataFrame, labels: DataFrame, limit: float, error: float) -> tuple[dict[str, dict[str, list[float]]], dict[str, int]]:
    """Cutoffs by stratum key, ratio and step; and the step taken of each stratum that has one."""
    worst = labels.select(F.col("doc_id").alias("of"), "quality").where("quality is not null").groupBy("of").agg(F.min("quality").alias("good"))
    judged = counted.where(~base_failed()).join(worst, F.col("doc_id") == F.col("of"))
    rows = judged.select(stratum_key().alias("key"), "stratum", "doc_id", (F.col("good") == 1).alias("good"), in_grid().alias("grid"), *NAMES)
    # of near copies one counts
    one = F.min_by(F.struct("good", "grid", *NAMES[:-1]), "doc_id").alias("one")
    rows = cut(rows.groupBy("key", "stratum", "least_window").agg(one).select("key", "stratum", "one.*"))
    shares = F.array(*[F.lit(q) for q, _ in STEPS])
    found = rows.where("grid AND good").groupBy("key").agg(*[F.percentile(F.round(v, 4), shares).alias(n) for n, v in ratios().items()]).collect()  # a row a stratum
    cutoffs = {r.key: {n: [q * f for q, (_, f) in zip(r[n], STEPS, strict=True)] for n in RATIOS} for r in found}
    held = rows.where("NOT grid").select("key", "good", first_step(cutoffs).alias("step")).groupBy("key", "good", "step").count().collect()  # a row a stratum, label and step
    strata = {r.key for r in held}
    taken = {}
    for key in strata & cutoffs.keys():
        counts = np.zeros((2, len(STEPS) + 1), np.int64)
        for r in held:
            if r.key == key:
                counts[int(r.good), r.step] += r["count"]
        rejected, good, best = counts.cumsum(axis=1), int(counts[1].sum()), 0
        for k in range(len(STEPS)):
            if not good or upper_bound(int(rejected[1, k]), good, error / len(strata)) > limit:
                break
            if rejected[0, k] > best:
                best, taken[key] = rejected[0, k], k
    return cutoffs, taken


def verdicts(docs: DataFrame, labels: DataFrame, limit: float = 0.03, error: float = 0.1) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept."""
    counted = cut(counts(docs))
    cutoffs, taken = chosen_steps(counted, labels, limit, error)
    rejected = F.lit(False)
    if taken:
        steps = F.create_map(*[F.lit(x) for pair in sorted(taken.items()) for x in pair])
        rejected = F.coalesce(first_step(cutoffs) <= F.element_at(steps, stratum_key()), F.lit(False))
    return counted.select("doc_id", *NAMES[:5], base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))
