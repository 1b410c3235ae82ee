"""Scalar text functions, of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from argloom.functions import cues

ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ’"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy'"
# Signs that stand for one another in spans.
QUOTES, APOSTROPHES, DASHES = "“”", "’‘`", "‐‑‒–—−"


def has(text: Column | str, pattern: str) -> Column:
    """Whether the pattern occurs, without case and with Unicode classes."""
    return F.col(text).rlike(cues.FLAGS + pattern) if isinstance(text, str) else text.rlike(cues.FLAGS + pattern)


def fold(text: Column) -> Column:
    """Lower case without accents; every character stays one character."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def neutralise_enumerations(text: Column) -> Column:
    """Numbers and letters that head a line ("12)", "a.", "iv)") become as many spaces, so offsets stay."""
    heads = {1: r"\d|[a-z]", 2: r"\d{2}|[ivxl]{2}", 3: r"\d{3}|[ivxl]{3}", 4: "[ivxl]{4}", 5: "[ivxl]{5}"}
    for n, head in heads.items():
        text = F.regexp_replace(text, rf"(?md)^([\ \t  ]*)(?:{head})[.)°](?=[\ \t  ]+\S)", "$1" + " " * (n + 1))
    return text


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def stems(text: Column) -> Column:
    """First five letters of folded words of three letters or more that are no stop words, each once."""
    stop = F.array(*map(F.lit, cues.STEM_STOP))
    long = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\w{3,}"), F.lit(0)), fold), lambda w: ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(long, lambda w: F.substring(w, 1, 5)))


def content_words(text: Column) -> Column:
    """Folded words longer than a letter that are no function words, each once."""
    stop = F.array(*map(F.lit, cues.MENTION_STOP))
    return F.array_distinct(F.filter(F.transform(words(text), fold), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def atom(text: Column) -> Column:
    """A name for logic programs: folded, anything else than letters, digits and underscores squeezed to one underscore."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9_]", "_"), "_+", "_"), "^_|_$", "")


def json_payload(raw: Column) -> Column:
    """The outermost object of a model's reply, without thoughts and code fences."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?is)<think>.*?</think>", ""), r"(?is)```(?:json)?", "")
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


def fingerprint(value: Column) -> Column:
    """16 hexadecimal digits of a value's canonical JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(value.alias("v"))), 256), 1, 16)


def truthy(value: Column) -> Column:
    return F.upper(F.substring(F.trim(F.coalesce(value.cast("string"), F.lit(""))), 1, 1)).isin("Y", "O", "1", "T")


def trimmed(text: Column, edges: str = " ,;:") -> Column:
    return F.btrim(text, F.lit(edges))


def occurrences(text: Column, span: Column) -> Column:
    """Places {start, end} where a span occurs: as it is, or else folded, with quotes and dashes of any kind and runs of blanks of any length. Line breaks are no blanks."""
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)")

    def places(t: Column, pattern: Column) -> Column:
        # what lies between the matches, and how long each match is
        parts, sizes = F.split(t, pattern, -1), F.transform(F.regexp_extract_all(t, pattern, F.lit(0)), F.length)
        steps = F.filter(F.arrays_zip(F.transform(parts, F.length).alias("skip"), sizes.alias("size")), lambda z: z["size"].isNotNull())
        return F.aggregate(
            steps, F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda a, z: F.struct((a["at"] + z["skip"] + z["size"]).alias("at"), F.array_append(a["out"], F.struct((a["at"] + z["skip"]).alias("start"), (a["at"] + z["skip"] + z["size"]).alias("end"))).alias("out")), lambda a: a["out"],
        )

    quoted = lambda s: F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    alike = lambda c: F.translate(fold(c), QUOTES + APOSTROPHES + DASHES, '"' * len(QUOTES) + "'" * len(APOSTROPHES) + "-" * len(DASHES))
    tolerant = F.regexp_replace(quoted(alike(span)), r"[ \t]+", r"\\E[ \\t]+\\Q")
    full = F.length(span) > 0
    exact = F.when(full, places(text, quoted(span))).otherwise(none)
    return F.when(F.size(exact) > 0, exact).otherwise(F.when(full, places(alike(text), tolerant)).otherwise(none))


def candidates(text: Column, span: Column) -> Column:
    """0-based places where a span occurs, see ``occurrences``."""
    return F.transform(occurrences(text, span), lambda x: x["start"])


def trimmed_span(span: Column) -> Column:
    """A span without the punctuation at its edges."""
    return F.btrim(span, F.lit(" \t\n\"'«».,;:"))


def locate_span(text: Column, span: Column, offset: Column | int = 0) -> Column:
    """{start, end} of the first occurrence of a span, edge punctuation aside; null if there is none. ``aligned.located`` finds reworded ones too."""
    at = F.get(occurrences(text, trimmed_span(span)), F.lit(0))
    return F.when(at.isNotNull(), F.struct((at["start"] + offset).cast("int").alias("start"), (at["end"] + offset).cast("int").alias("end")))


def atom_id(identifier: Column) -> Column:
    """An identifier as a constant of a logic program: T12 is t12."""
    return F.lower(identifier)
