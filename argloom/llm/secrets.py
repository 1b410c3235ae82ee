"""Secret scan with built-in functions only: patterns, and character Markov models for what no pattern names.

Two bigram models, one of random strings and one of ordinary identifiers, are counted
from labelled words and held as one table of log-likelihood ratios. ``labelled`` takes
them from every row of the table that is scanned: the keys that patterns find and seeded
digests are random; identifiers and words outside all patterns' matches are ordinary,
each distinct one with how often it stands there. ``fit`` trains on four fifths of them and sets
the threshold so that FALSE_RATE of the other ordinary runs exceed it. A run of key
characters is a secret if the ratio, summed over its bigrams, exceeds the threshold; it
is added as a ``random`` span unless a pattern's span overlaps it. In every other run,
what ordinary text or a pattern's span is joined to is searched for parts whose own sum
exceeds the threshold: a running sum starts anew at 0, at a pattern's span, and where it
fell by the threshold from its peak; each part ends at its peak. They are ``inner`` spans.

Positions are code points: the text is split at the matches, and the lengths of pieces
and matches are summed, so the time grows with the text. Everything is one projection over the text, without a shuffle;
the table has a fixed size.

Defined cases: a null text counts as empty and gives no spans; the digest of no spans
is that of the empty string; ids may be null or repeat; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argloom.llm.util import cut
from argloom.operators.segment import ran

#: The patterns, in order of their kinds; the least length counts in the group named.
KINDS = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
#: Longest pattern runs are found by their first characters; a maximal hex run is the same with its least length in the pattern.
HEX_RUN = r"[0-9a-f]{24,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SPANS = "ARRAY<STRUCT<start: INT, rank: INT, end: INT, kind: STRING, word: STRING>>"
#: Share of ordinary runs, not trained on, that may be taken for secrets; and the least threshold, for samples too few to tell.
FALSE_RATE, LEAST_THRESHOLD = 1e-4, 8.0


def digests(spark: SparkSession, n: int = 4000) -> DataFrame:
    """word, label (1): seeded random strings in three spellings."""
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    random = F.when(F.col("id") % 3 == 0, F.base64(F.unhex(digest))).when(F.col("id") % 3 == 1, F.substring(digest, 1, 40)).otherwise(
        F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 256))), "[+/=]", "")
    )
    return spark.range(n).select(random.alias("word"), F.lit(1).alias("label"))


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, label (1 random, 0 ordinary), times: the distinct ones of all rows, and seeded digests. Ordinary words are of eight characters or more, outside all matches."""
    access = r"AKIA[A-Z0-9]{16,}"
    keys = F.concat(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (HEX_RUN, access)])
    rest = F.regexp_replace("t", f"{KINDS[0][1]}|{HEX_RUN}|{access}", " ")
    words = F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{8,}"), F.lit(0))
    of = lambda c, label: F.transform(c, lambda w: F.struct(w.alias("word"), F.lit(label).alias("label")))
    found = docs.select(F.col(text).alias("t")).where("t IS NOT NULL").select(F.inline(F.concat(of(keys, 1), of(words, 0))))
    return cut(found.unionAll(digests(docs.sparkSession)).groupBy("word", "label").agg(F.count("*").alias("times")))


def fit(samples: DataFrame) -> tuple[list[float], float]:
    """The table of ratios, from four fifths of the words (word, label, and times if they are distinct), and the threshold that at most FALSE_RATE of the ordinary runs among the rest exceeds."""
    samples = samples if "times" in samples.columns else samples.withColumn("times", F.lit(1))
    part = F.pmod(F.xxhash64("word"), F.lit(5))
    table = train(samples.where(part < 4))
    held = samples.where((part == 4) & (F.col("label") == 0) & F.col("word").rlike(f"^{CANDIDATE}$"))
    score = F.aggregate(ratios("word", table), F.lit(0.0), lambda a, v: a + v)
    return table, max(LEAST_THRESHOLD, exceeded(cut(held.select(score.alias("s"), "times")), FALSE_RATE))


def exceeded(scores: DataFrame, share: float, ranges: int = 1024) -> float:
    """The least score (s, so many times) that at most a share of all exceeds; 0 for none. Counts of ranges, narrowed to the one that holds it until that has a single score, so no task sorts them."""
    n, low, high = scores.agg(F.coalesce(F.sum("times"), F.lit(0)), F.min("s"), F.max("s")).first()
    if not n:
        return 0.0
    above, allowed = 0, math.floor(share * n)
    while low < high:
        width = (high - low) / ranges
        at = F.least(F.floor((F.col("s") - low) / width), F.lit(ranges - 1)) if width > 0 else F.lit(0)
        inside = scores.where(F.col("s").between(low, high)).groupBy(at.alias("k")).agg(F.sum("times").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()  # a row a range
        for r in sorted(inside, key=lambda r: -r["k"]):
            if above + r["n"] > allowed:
                break
            above += r["n"]
        if len(inside) == 1:  # ranges as narrow as doubles get
            return r["high"]
        low, high = r["low"], r["high"]
    return low


def bigrams(word: Column) -> Column:
    """Numbers of a word's bigrams. The word falls into letters once, as a place in a text is found by walking to it."""
    letters = F.transform(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    both = F.zip_with(letters, F.slice(letters, 2, F.greatest(F.length(word) - 1, F.lit(0))), lambda a, b: a * len(ALPHABET) + b)
    return F.filter(both, lambda p: p.isNotNull())


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each bigram, random over ordinary, with one added to each count; characters outside the alphabet are dropped."""
    k = len(ALPHABET)
    times = F.col("times") if "times" in labelled.columns else F.lit(1)
    clean = labelled.select(F.regexp_replace("word", r"[^A-Za-z0-9+/_=-]", "").alias("word"), "label", times.alias("times")).where("length(word) > 1")
    seen = clean.select("label", "times", F.explode(bigrams(F.col("word"))).alias("pair"))
    counts = [[1.0] * (k * k), [1.0] * (k * k)]
    for r in seen.groupBy("label", "pair").agg(F.sum("times").alias("n")).collect():  # at most two rows a bigram
        counts[r.label][r.pair] += r["n"]
    rows = [[sum(c[i * k : i * k + k]) for i in range(k)] for c in counts]
    return [math.log(counts[1][p] / rows[1][p // k]) - math.log(counts[0][p] / rows[0][p // k]) for p in range(k * k)]


def ratios(word: Column | str, table: list[float]) -> Column:
    """Log-likelihood ratio of each bigram of a word."""
    return F.transform(bigrams(F.col(word) if isinstance(word, str) else word), lambda p: F.element_at(F.array(*map(F.lit, table)), p + 1))


def barred(x: Column, lo: Column, hi: Column, reach: Column) -> Column:
    """Of each character of a span, whether a pattern's span holds it: those from lo up to hi of ``__covers`` (each with ``upto``, where the ones before it end) begin in x, and those before end at reach."""
    begun = F.slice("__covers", lo + 1, hi - lo)
    flags = lambda value, n: F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))

    def part(y: Column) -> Column:
        upto = F.greatest(y["upto"], x["start"])
        return F.concat(flags(False, y["start"] - upto), flags(True, F.least(y["end"], x["end"]) - F.greatest(y["start"], upto)))

    last = F.greatest(F.coalesce(F.array_max(F.transform(begun, lambda y: y["end"])), F.lit(0)), reach, x["start"])
    return F.concat(flags(True, F.least(reach, x["end"]) - x["start"]), F.flatten(F.transform(begun, part)), flags(False, x["end"] - last))


def inner(x: Column, values: Column, threshold: float) -> Column:
    """Array of spans: the parts of a span's word whose running sum of ``values`` peaks above the threshold."""

    def part(a: Column) -> Column:
        start, end = x["start"] + a["start"], x["start"] + a["end"]
        word = F.substr(x["word"], a["start"] + 1, a["end"] - a["start"])
        found = F.array(F.struct(start.alias("start"), x["rank"].alias("rank"), end.alias("end"), F.lit("inner").alias("kind"), word.alias("word")))
        return F.when(a["peak"] > threshold, F.concat(a["out"], found)).otherwise(a["out"])

    def step(a: Column, v: Column) -> Column:
        total = a["sum"] + v
        peak = F.greatest(a["peak"], total)
        over = (total <= 0) | (peak - total >= threshold)
        after = F.when(over, a["at"] + 1).otherwise(a["start"])
        return F.struct(
            (a["at"] + 1).alias("at"), F.when(over, 0.0).otherwise(total).alias("sum"), F.when(over, 0.0).otherwise(peak).alias("peak"), after.alias("start"),
            F.when(total > a["peak"], a["at"] + 2).otherwise(a["end"]).alias("end"), F.when(over, part(a)).otherwise(a["out"]).alias("out"),
        )

    none = F.expr(f"CAST(array() AS {SPANS})")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), F.lit(0).alias("start"), F.lit(0).alias("end"), none.alias("out"))
    return F.aggregate(values, zero, step, part)


def _found(df: DataFrame, name: str, pattern: str, group: int, least: int, rank: int) -> DataFrame:
    """df with an array of (start, rank, end, kind, word) of a pattern's matches of the least length, from them and the pieces between them, whose lengths are summed in strides."""
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    df = df.withColumn("__found", F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("__value", F.regexp_extract_all("__text", F.lit(pattern), F.lit(group)) if group else F.col("__found"))
    df = df.withColumn("__pieces", F.when(F.size("__found") > 0, F.split("__text", pattern, -1)).otherwise(none))
    df = ran(df, "__at", ["__pieces", "__found"], lambda z: F.coalesce(F.length(z["__pieces"]) + F.length(z["__found"]), F.lit(0)), lambda a, n: a + n)
    spans = F.transform(F.slice(F.arrays_zip("__pieces", "__found", "__value", "__at"), 1, F.size("__found")), lambda z: F.struct(
        (z["__at"] + F.length(z["__pieces"])).alias("start"), F.lit(rank).alias("rank"), (z["__at"] + F.length(z["__pieces"]) + F.length(z["__found"])).alias("end"),
        F.lit(name).alias("kind"), z["__found"].alias("word"), F.length(z["__value"]).alias("long"),
    ))
    kept = F.transform(F.filter(spans, lambda x: x["long"] >= least), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind", "word")]))
    return df.withColumn(f"__{name}", kept)


def scan(docs: DataFrame, table: list[float], threshold: float = 12.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_<kind> of each pattern, base_sha256, spans (all), n_random, and of the spans inside runs inner_spans and n_inner."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    for rank, (kind, pattern, group, least) in enumerate([*KINDS, ("random", CANDIDATE, 0, 12)]):
        df = _found(df, kind, HEX_RUN if kind == "hex" else pattern, group, least, rank)
    df = df.withColumn("__base", F.array_sort(F.concat(*[F.col(f"__{k}") for k, *_ in KINDS])))
    # where the patterns' spans so far end, before each of them and before each run: all starts and ends in one order, counted along it
    df = ran(df, "__upto", ["__base"], lambda z: z["__base"]["end"], F.greatest)
    df = df.withColumn("__covers", F.transform(F.arrays_zip("__base", "__upto"), lambda z: F.struct(z["__base"]["start"].alias("start"), z["__base"]["end"].alias("end"), z["__upto"].alias("upto"))))
    event = lambda at, kind, end: F.struct(at.alias("at"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))
    begins, ends = F.transform("__random", lambda x: event(x["start"], 0, F.lit(0))), F.transform("__random", lambda x: event(x["end"], 1, F.lit(0)))
    df = df.withColumn("__events", F.array_sort(F.concat(begins, ends, F.transform("__base", lambda y: event(y["start"], 2, y["end"])))))
    df = ran(df, "__count", ["__events"], lambda z: (z["__events"]["kind"] == 2).cast("int"), lambda a, n: a + n)
    df = ran(df, "__reach", ["__events"], lambda z: z["__events"]["end"], F.greatest)
    df = df.withColumn("__events", F.arrays_zip("__events", "__count", "__reach"))
    of = lambda kind: F.filter("__events", lambda e: e["__events"]["kind"] == kind)
    df = df.withColumn("__first", of(0)).withColumn("__last", of(1))
    df = df.withColumn("__runs", F.transform(F.arrays_zip("__random", "__first", "__last"), lambda z: F.struct(
        z["__random"].alias("x"), z["__first"]["__count"].alias("lo"), z["__last"]["__count"].alias("hi"), z["__first"]["__reach"].alias("reach"),
    )))

    def weighed(r: Column) -> Column:
        x, own = r["x"], ratios(r["x"]["word"], table)
        free = (r["hi"] == r["lo"]) & (r["reach"] <= x["start"])
        held = barred(x, r["lo"], r["hi"], r["reach"])
        touched = F.zip_with(held, F.slice(held, 2, F.size(own)), lambda a, b: a | b)
        return F.struct(x.alias("x"), free.alias("free"), F.when(free, own).otherwise(F.zip_with(own, F.slice(touched, 1, F.size(own)), lambda v, h: F.when(h, F.lit(-math.inf)).otherwise(v))).alias("values"))

    df = df.withColumn("__runs", F.transform("__runs", weighed))
    whole = lambda r: r["free"] & (F.aggregate(r["values"], F.lit(0.0), lambda a, v: a + v) > threshold)
    df = df.withColumn("__random", F.transform(F.filter("__runs", whole), lambda r: r["x"]))
    df = df.withColumn("__inner", F.flatten(F.transform(F.filter("__runs", lambda r: ~whole(r)), lambda r: inner(r["x"], r["values"], threshold))))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return df.select(
        "doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k, *_ in KINDS],
        F.sha2(written("__base"), 256).alias("base_sha256"), written(F.array_sort(F.concat("__base", "__random", "__inner"))).alias("spans"), F.size("__random").cast("long").alias("n_random"),
        written("__inner").alias("inner_spans"), F.size("__inner").cast("long").alias("n_inner"),
    )
