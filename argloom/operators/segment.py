"""Documents into propositions with exact offsets.

Cuts are marked in the text by control characters and the text is split at them, so a
piece's place is the sum of the lengths before it; what is glue (line breaks, blanks
between sentences, connectors) is a piece of its own that is left out. Everything is a
projection: no shuffle, no Python. Output: one row per segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.functions import cues
from argloom.functions.text import fold

LEAST = 6
CUT, GLUE = "\\u0001", "\u0001\u0002"
IN = r"[^\u0001]"
#: A search inside a piece starts at the piece or after the cut before, nowhere else: long pieces are walked once.
FROM = r"(?:\G|(?<=\u0001))"
#: What is somewhere in a text, in lower case, if a ranking is: stems of all cues and comparatives, any letter for an accented one.
STEMS = r"p(?:r(?:im|.vaut|.f.r|iorit|ivil)|ass)|emporte|supplante|d.triment|le pas"
#: What a ranking looks like in folded text.
RANKS = "(?U)" + "|".join([r"(?<!\w)(?:" + "|".join(sorted(cues.RANKING_FOLDED, key=len, reverse=True)) + r")(?!\w)", cues.COMPARATIVE_FOLDED, cues.ELIDED_WINNER_FOLDED, cues.ELIDED_LOSER_FOLDED])


def marked(text: Column) -> Column:
    """The text with its cuts marked; the marks themselves have no length."""
    b, f = cues.BLANKS, cues.FLAGS
    # the number or letter that heads a line is glue like the blanks around it
    head = r"(?:\d{1,3}|[a-z]|[ivxl]{2,5})[.)°](?=[\ \t\u00a0\u202f]+\S)"
    t = F.regexp_replace(text, rf"\A(?:[{b}]+(?:(?<=[\n\ \t\u00a0\u202f]){head}[{b}]*)?|{head}[{b}]*)|\n[{b}]*(?:{head}[{b}]*)?", f"{GLUE}$0\u0001")
    # sentences: not after an abbreviation, a lone letter or a number, and not before a small letter
    t = F.regexp_replace(t, rf"{f}(?=[.!?;])(?<!(?:\b\w|\b\d{{1,9}}|\b(?:{cues.ABBREVIATIONS}))\.?\s{{0,4}})([.!?;][\"'»)\]]*)([\s&&[^\n]]++)(?-i:(?!\p{{Ll}}))", f"$1{GLUE}$2\u0001")
    # commas and colons with enough on both sides, the mark staying on the left
    t = F.regexp_replace(t, rf"(?=[,:])(?<={IN}{{{LEAST - 1}}})([,:])(?=[\s&&[^\u0001]]++{IN}{{{LEAST}}})", "$1\u0001")
    t = F.regexp_replace(t, rf"{f}{FROM}({IN}{{{LEAST},}}?)\b(?=(?:{cues.INLINE})\b)(?<!\by\s{{1,3}}compris\s{{0,3}})((?:{cues.INLINE})\b)(?={IN}{{{LEAST}}})", f"$1{GLUE}$2\u0001")
    t = F.regexp_replace(t, rf"{f}{FROM}({IN}{{{LEAST},}}?)(?={cues.NOMINAL})(?<!\w)", "$1\u0001")
    t = F.regexp_replace(t, rf"{f}((?:^|(?<=\u0001))\s*chez\s{IN}+?)(\bet\s+)(?=sans\b{IN}{{2}})", f"$1{GLUE}$2\u0001")
    return F.regexp_replace(t, rf"{f}(?:^|(?<=\u0001))(?=\s*{cues.CONDITIONAL_HEAD})({IN}{{{LEAST},}}?)(\b(?:alors|then)\b)(?={IN}{{{LEAST}}})", f"$1{GLUE}$2\u0001")


#: Elements folded one after the other in a running fold; their totals are folded in turn, so the work stays near the array's length.
STRIDE = 128


def folded(ints: Column, over: Callable[[Column, Column], Column]) -> Column:
    """{at: the fold of ints from 0, out: what it was before each}."""
    first = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<INT>)").alias("out"))
    return F.aggregate(ints, first, lambda a, n: F.struct(over(a["at"], n).cast("int").alias("at"), F.array_append(a["out"], a["at"]).alias("out")))


def measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and pieces: the text's pieces with their places and what each adds to what is counted along the text."""
    b = cues.BLANKS
    head = rf"^[{b}]*(?:(?:\d{{1,3}}|[a-z]|[ivxl]{{1,5}})[.)°][{b}]+(?=\S))?"
    df = docs.select(F.col(doc_id).alias("doc_id"), F.translate(F.coalesce(F.col(text), F.lit("")), "\u0001\u0002", "  ").alias("text"))
    df = df.withColumn("x", F.split(marked(F.col("text")), CUT, -1))
    # lengths are worked out in transforms, so that each pattern runs once a piece
    df = df.withColumn("x", F.transform("x", lambda p: F.struct(p.startswith("\u0002").alias("glue"), F.when(p.startswith("\u0002"), F.substr(p, F.lit(2))).otherwise(p).alias("p"))))
    df = df.withColumn("x", F.transform("x", lambda x: F.struct(x["glue"].alias("glue"), x["p"].alias("p"), F.length(x["p"]).alias("n"), F.when(x["glue"], 0).otherwise(F.length(F.regexp_extract(x["p"], head, 0))).alias("lead"))))
    df = df.withColumn("x", F.transform("x", lambda x: F.struct(x["glue"].alias("glue"), x["p"].alias("p"), x["n"].alias("n"), x["lead"].alias("lead"), F.when(x["glue"], "").otherwise(F.substr(x["p"], x["lead"] + 1)).alias("rest"))))
    marks = lambda t: F.length(F.regexp_extract(t, r"(?s)\A.*[.!?\n]", 0))
    df = df.withColumn("x", F.transform("x", lambda x: F.struct(
        x["glue"].alias("glue"), x["p"].alias("p"), x["n"].alias("n"), x["lead"].alias("lead"), (F.length(x["rest"]) - F.length(F.rtrim(x["rest"], F.lit(" \t\r\n\u00a0\u202f.,;:")))).alias("tail"),
        x["rest"].rlike(f"{cues.FLAGS}^{cues.INSERTION}").alias("inserted"), marks(x["p"]).alias("mark"), F.when(x["lead"] > 0, marks(F.substr(x["p"], F.lit(1), x["lead"]))).otherwise(0).alias("lead_mark"),
        (F.trim(F.translate(x["p"], "\t\r\n", "   ")) != "").cast("int").alias("full"), (x["glue"] & x["p"].contains("\n\n")).alias("block"),
    )))

    add = lambda a, n: a + n
    df = ran(ran(df, "at", ["x"], lambda z: z["x"]["n"], add), "filled", ["x"], lambda z: z["x"]["full"], add)
    df = ran(df, "opened", ["x", "at"], lambda z: F.when(z["x"]["mark"] > 0, z["at"] + z["x"]["mark"]).otherwise(0), F.greatest)
    # a block counts if it holds anything: if more is filled than at the block's end before
    df = ran(df, "ended", ["x", "filled"], lambda z: F.when(z["x"]["block"], z["filled"]).otherwise(0), F.greatest)
    df = ran(df, "paragraph", ["x", "filled", "ended"], lambda z: (z["x"]["block"] & (z["filled"] > z["ended"])).cast("int"), add)
    # speakers' names open lines; a turn goes on until the next
    last = F.concat(F.array(F.lit("\n")), F.transform("x", lambda x: F.right(x["p"], F.lit(1))))
    opens = lambda z: (z["at"] == 0) | (z["last"] == "\n")
    name = lambda z: F.when(~z["x"]["glue"] & opens(z), F.nullif(F.regexp_extract(z["x"]["p"], cues.SPEAKER, 1), F.lit("")))
    named = F.transform(F.slice(F.arrays_zip("x", "at", last.alias("last")), 1, F.size("x")), name)
    df = df.withColumn("name", F.when(F.regexp_like("text", F.lit(cues.SPEAKER)), named).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)")))
    df = df.withColumn("cast", F.array_distinct(F.filter("name", lambda x: x.isNotNull())))
    df = df.withColumn("turn", F.transform("name", lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)))
    df = ran(df, "earlier", ["turn"], lambda z: z["turn"], F.greatest)
    # where sentences end, of texts with a ranking: pieces with a mark that opens the next, and with one that ends the last
    df = df.withColumn("ranked", F.lower("text").rlike(STEMS))
    for name, has in (("open", lambda x: x["mark"] > 0), ("stop", lambda x: x["p"].rlike(r"[.\n]"))):
        df = df.withColumn("v", F.when(F.col("ranked"), F.transform("x", has)).otherwise(F.expr("CAST(array() AS ARRAY<BOOLEAN>)")))
        df = df.withColumn(f"{name}s", F.filter(F.transform("v", lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))
        df = ran(df, f"{name}s_before", ["v"], lambda z: z["v"].cast("int"), add)
    return df.select(
        "doc_id", "text", "cast", "name", "ranked", "opens", "opens_before", "stops", "stops_before",
        F.arrays_zip("x", "at", "opened", "paragraph", F.transform(F.arrays_zip("turn", "earlier"), lambda z: F.greatest(z["turn"], z["earlier"])).alias("turn")).alias("x"),
    )


def ran(df: DataFrame, name: str, of: list[str], value: Callable[[Column], Column], over: Callable[[Column, Column], Column]) -> DataFrame:
    """df with an array of what a fold over a value of each element of zipped arrays gives before it.

    Arrays are zipped and not looked up by place: the optimizer would move what makes a
    column that is used once into the function, to be worked out anew for each element.
    """
    df = df.withColumn("v", F.transform(F.arrays_zip(*of), value))
    df = df.withColumn("v", F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / STRIDE).cast("int")), lambda k: F.slice("v", k * STRIDE + 1, STRIDE)))
    df = df.withColumn("v", F.transform("v", lambda part: folded(part, over)))
    df = df.withColumn("base", folded(F.transform("v", lambda p: p["at"]), over)["out"])
    return df.withColumn(name, F.flatten(F.transform(F.arrays_zip("v", "base"), lambda z: F.transform(z["v"]["out"], lambda n: over(z["base"], n).cast("int"))))).drop("v", "base")


def segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, seg_no (from 1), start, end, seg_text, gap (text since the segment before), prefix_end (last mark before), sentence (of segments with a ranking cue, else null), sentence_open, paragraph, speaker.

    Segments are worked out within the row of their document and leave it as finished
    structs: no row but the document's holds its text, and the work grows with its length.
    A null or empty text has no segments; control characters 1 and 2 count as blanks.
    """
    b, x, y = cues.BLANKS, lambda i: F.get("x", i)["x"], lambda i: F.get("x", i)
    df = measured(docs, doc_id, text)
    kept = lambda p: ~p["glue"] & (p["n"] - p["lead"] - p["tail"] >= LEAST)
    df = df.withColumn("raw", F.filter(F.transform("x", lambda z, i: F.when(kept(z["x"]), i)), lambda i: i.isNotNull()))

    def between(i: Column, j: Column) -> Column:
        """The text after the segment that ends in piece i (-1: the text's start) up to the one that begins in piece j."""
        middle = F.transform(F.slice("x", i + 2, j - i - 1), lambda z: z["x"]["p"])
        return F.concat(F.when(i < 0, "").otherwise(F.right(x(i)["p"], x(i)["tail"])), F.array_join(middle, ""), F.substr(x(j)["p"], F.lit(1), x(j)["lead"]))

    # an insertion after nothing but blanks and commas goes on with the segment before it
    def goes_on(i: Column, k: Column) -> Column:
        return F.when((k > 0) & x(i)["inserted"], between(F.get("raw", k - 1), i).rlike(rf"^[{b},:]*$")).otherwise(F.lit(False))

    df = df.withColumn("firsts", F.filter(F.transform("raw", lambda i, k: F.when(~goes_on(i, k), k)), lambda k: k.isNotNull()))
    last = lambda k: F.get("raw", F.coalesce(F.get("firsts", k + 1), F.size("raw")) - 1)
    df = df.withColumn("runs", F.transform("firsts", lambda f, k: F.struct(F.get("raw", f).alias("i"), last(k).alias("j"), F.when(k > 0, last(k - 1)).otherwise(-1).alias("before"))))

    def words(r: Column) -> Column:
        i, j = r["i"], r["j"]
        one = F.substr(x(i)["p"], x(i)["lead"] + 1, x(i)["n"] - x(i)["lead"] - x(i)["tail"])
        middle = F.transform(F.slice("x", i + 2, j - i - 1), lambda z: z["x"]["p"])
        return F.when(i == j, one).otherwise(F.concat(F.substr(x(i)["p"], x(i)["lead"] + 1), F.array_join(middle, ""), F.substr(x(j)["p"], F.lit(1), x(j)["n"] - x(j)["tail"])))

    found = F.transform("runs", lambda r, k: F.struct(
        r.alias("r"), (k + 1).alias("seg_no"), (y(r["i"])["at"] + x(r["i"])["lead"]).alias("start"), (y(r["j"])["at"] + x(r["j"])["n"] - x(r["j"])["tail"]).alias("end"),
        words(r).alias("seg_text"), between(r["before"], r["i"]).alias("gap"), F.when(r["before"] >= 0, F.right(F.substr(x(r["before"])["p"], F.lit(1), x(r["before"])["n"] - x(r["before"])["tail"]), F.lit(1))).otherwise("").alias("last"),
        F.when(x(r["i"])["lead_mark"] > 0, y(r["i"])["at"] + x(r["i"])["lead_mark"]).otherwise(y(r["i"])["opened"]).alias("sentence_open"), y(r["i"])["paragraph"].alias("paragraph"),
        F.when(y(r["i"])["turn"] > 0, F.array_position(F.col("cast"), F.get(F.col("name"), y(r["i"])["turn"] - 1)) - 1).otherwise(F.lit(0)).cast("int").alias("speaker"),
    ))
    def sentence(r: Column, seg_text: Column) -> Column:
        """From the last mark before a segment to the next one after it, put together of the pieces in between."""
        i, j = r["i"], r["j"]
        opener = F.coalesce(F.get("opens", F.get("opens_before", i) - 1), F.lit(-1))
        inside = x(i)["lead_mark"]
        before = F.when(inside > 0, F.substr(x(i)["p"], inside + 1, x(i)["lead"] - inside)).otherwise(F.concat(
            F.when(opener < 0, "").otherwise(F.right(x(opener)["p"], x(opener)["n"] - x(opener)["mark"])),
            F.array_join(F.transform(F.slice("x", opener + 2, i - opener - 1), lambda z: z["x"]["p"]), ""), F.substr(x(i)["p"], F.lit(1), x(i)["lead"]),
        ))
        tail = F.right(x(j)["p"], x(j)["tail"])
        stop = F.coalesce(F.get("stops", F.get("stops_before", j) + x(j)["p"].rlike(r"[.\n]").cast("int")), F.size("x"))
        upto = lambda t: F.regexp_extract(t, r"^[^.\n]*+[.\n]?", 0)
        onward = F.concat(tail, F.array_join(F.transform(F.slice("x", j + 2, stop - j - 1), lambda z: z["x"]["p"]), ""), F.coalesce(upto(x(stop)["p"]), F.lit("")))
        return F.concat(before, seg_text, F.when(tail.rlike(r"[.\n]"), upto(tail)).otherwise(onward))

    fields = ["seg_no", "start", "end", "seg_text", "gap", "last", "sentence_open", "paragraph", "speaker"]
    df = df.withColumn("found", found)
    zipped = F.arrays_zip(F.col("found").alias("s"), F.array_repeat("ranked", F.size("found")).alias("ranked"))
    df = df.withColumn("found", F.transform(zipped, lambda z: F.struct(
        *[z["s"][f].alias(f) for f in fields], F.when(z["ranked"], F.when(fold(z["s"]["seg_text"]).rlike(RANKS), sentence(z["s"]["r"], z["s"]["seg_text"]))).alias("sentence"),
    )))
    # outer, as else a filter on the array's size is inferred and all of the above is worked out again for it
    one = df.select("doc_id", F.inline_outer("found")).where("seg_no IS NOT NULL").withColumn("bare", F.rtrim("gap", F.lit(" \t\r\n")))
    return one.select("doc_id", "seg_no", "start", "end", "seg_text", "gap", F.when(F.col("bare") != "", F.right("bare", F.lit(1))).otherwise(F.col("last")).alias("prefix_end"), "sentence", "sentence_open", "paragraph", "speaker")
