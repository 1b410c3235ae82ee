"""What a dependency parse adds, where there is one: no parser runs here, its output is a table.

Tokens: doc_id, seg_no (the fragment that was parsed), i (from 0, without gaps), head
(the root is its own head), start (in the fragment), text, lemma, pos, dep, morph
("Tense=Past|VerbForm=Part"; null: none), with universal part-of-speech and relation
names. A fragment's tokens are gathered into one row by one shuffle; all else are
projections of that row. A fragment without tokens has no row: what is left to its
caller is then the surface rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.functions import cues
from argloom.functions.text import atom, fold, has
from argloom.operators.segment import LEAST

TOKENS = "doc_id BIGINT, seg_no INT, i INT, head INT, start INT, text STRING, lemma STRING, pos STRING, dep STRING, morph STRING"
KEYS = ("doc_id", "seg_no")
#: Longest segment that can be a connector cut off from its clause.
LONGEST_CONNECTOR = 48

# Relations of subjects, words of exception and concession, negations, words without content, nouns and adverbs that date an event.
SUBJECTS = ["nsubj", "nsubj:pass", "expl:subj"]
EXCEPTIONS = ["sauf", "hormis", "excepté", "même"]
CONCESSIVES = ["sauf", "même", "hormis", "excepté", "quoique", "bien"]
NEGATIONS = ["ne", "n", "pas", "plus", "jamais", "aucun", "aucune", "rien", "nul"]
EMPTY_NOMINAL = "le la les un une des du de d au aux ce cet cette ces son sa ses leur leurs et".split()
TIMES = ["nuit", "heure", "lendemain", "veille", "hier", "matin", "soir", "aujourd", "demain", "minuit", "midi", "apres-midi", "moment"]
TIME_RELATIONS = ["obl", "obl:mod", "advmod", "nmod"]
TENSE_BEARERS = ["cop", "aux:tense", "aux:pass"]
SUBORDINATOR = r"\b(?:si|s['’]ils?|lorsque|lorsqu['’]|quand|où|dès\s+que|à\s+moins\s+que|pour\s+autant\s+que)\b"
COMMA_CUE = r"\b(?:si\b|lorsqu|quand\b|comme\b|en\s+l['’]absence\b|y\s+compris\b)"
COMMA_HEAD = r"^\s*(?:si\b|lorsqu|quand\b|comme\b)"


def fragments(tokens: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys and t: a fragment's tokens in order, each with ``up``, itself and all it hangs from."""
    token = F.struct("i", "head", "start", "text", "lemma", "pos", "dep", F.coalesce("morph", F.lit("")).alias("morph"))
    rows = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(token)).alias("t"))

    def climb(path: Column) -> Column:
        last = F.element_at(path, -1)
        above = F.get("t", last)["head"]
        return F.when(above.isNull() | (above == last), path).otherwise(F.array_append(path, above))

    return rows.withColumn("t", F.transform("t", lambda x: x.withField("up", F.aggregate("t", F.array(x["i"]), lambda path, _: climb(path)))))


def _hangs(x: Column, of: Column) -> Column:
    return (x["head"] == of["i"]) & (x["i"] != of["i"])


def _child(t: Column, of: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(t, lambda c: _hangs(c, of) & test(c))


def _finite(x: Column) -> Column:
    return x["pos"].isin("VERB", "AUX") & x["morph"].rlike(r"VerbForm=(?:\w+,)*Fin\b")


def _past(x: Column) -> Column:
    return x["morph"].rlike(r"Tense=(?:\w+,)*(?:Past|Imp|Pqp)\b")


def _words(t: Column) -> Column:
    return F.filter(t, lambda x: ~x["pos"].isin("PUNCT", "SPACE"))


def _span(t: Column) -> Column:
    return F.struct(F.array_min(F.transform(t, lambda x: x["start"])).alias("start"), F.array_max(F.transform(t, lambda x: x["start"] + F.length(x["text"]))).alias("end"))


def _roots(t: Column) -> Column:
    return F.filter(t, lambda x: x["head"] == x["i"])


def opens_clause(t: Column) -> Column:
    """Whether a subject hangs from a verb that is finite or has a finite auxiliary."""
    return F.exists(t, lambda x: x["dep"].isin("nsubj", "nsubj:pass") & F.exists(
        t, lambda h: (h["i"] == x["head"]) & h["pos"].isin("VERB", "AUX") & (_finite(h) | _child(t, h, lambda c: (c["pos"] == "AUX") & _finite(c)))
    ))


def can_conclude(t: Column) -> Column:
    """Not what opens with a subordinator, a coordinator, a relative pronoun or a concession."""
    words = _words(t)
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    bound = first["pos"].isin("SCONJ", "CCONJ") | (first["dep"] == "mark") | (first["pos"] == "PRON") & first["morph"].contains("PronType=Rel")
    conceded = (F.lower(first["text"]) == "même") & F.coalesce(second["pos"] == "ADP", F.lit(False))
    return ~F.coalesce(bound | conceded, F.lit(False))


def can_condition(t: Column) -> Column:
    """Not a connector alone, nor what opens with an exception or concession and a subordinator."""
    words = _words(t)
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    alone = (F.size(words) == 1) & first["pos"].isin("ADV", "CCONJ")
    conceded = F.lower(first["text"]).isin(CONCESSIVES) & F.coalesce(second["pos"] == "SCONJ", F.lit(False))
    return ~F.coalesce(alone | conceded, F.lit(False))


def coordinated_cuts(t: Column) -> Column:
    """Where a fragment falls into coordinated subordinates ("comme A | et que B"): before each conjunct with a subordinator, its coordinator included."""
    heads = F.filter(t, lambda x: (x["dep"] == "conj") & _child(t, x, lambda c: c["dep"] == "mark"))
    # a conjunct's coordinator hangs from it, so it lies in the subtree
    places = F.transform(heads, lambda x: F.array_min(F.transform(F.filter(t, lambda c: F.array_contains(c["up"], x["i"])), lambda c: c["start"])))
    return F.array_sort(F.array_distinct(F.filter(places, lambda p: p > 0)))


def divided(segments: DataFrame, tokens: DataFrame, least: int = LEAST) -> DataFrame:
    """segments cut before coordinated subordinates and numbered again, with ``younger``: whether a row continues the one before it, and old_no and shift: the segment it was and its place there. Pieces under the least length go to the gap."""
    cuts = fragments(tokens).select("doc_id", "seg_no", coordinated_cuts(F.col("t")).alias("cuts"))
    rows = segments.join(cuts, ["doc_id", "seg_no"], "left")
    bounds = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.expr("CAST(array() AS ARRAY<INT>)")), F.array(F.length("seg_text")))

    def piece(k: Column) -> Column:
        a, b = F.get("bounds", k), F.get("bounds", k + 1)
        raw = F.substr("seg_text", a + 1, b - a)
        lead, tail = F.length(raw) - F.length(F.ltrim(raw, F.lit(" \t\r\n"))), F.length(raw) - F.length(F.rtrim(raw, F.lit(" \t\r\n.,;:")))
        return F.struct(k.alias("k"), (a + lead).alias("s"), (b - tail).alias("e"))

    all_pieces = F.when(F.size("bounds") > 2, F.filter(F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), piece), lambda x: x["e"] - x["s"] >= least))
    whole = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("s"), F.length("seg_text").alias("e")))
    rows = rows.withColumn("bounds", bounds).withColumn("pieces", F.coalesce(all_pieces, whole))
    rows = rows.select("*", F.posexplode("pieces").alias("pos", "x")).withColumn("last", F.when(F.col("pos") > 0, F.get("pieces", F.col("pos") - 1)))
    inner = F.col("last").isNotNull()
    gap = F.when(inner, F.substr("seg_text", F.col("last.e") + 1, F.col("x.s") - F.col("last.e"))).otherwise(F.concat("gap", F.substr("seg_text", F.lit(1), F.col("x.s"))))
    rows = rows.withColumn("gap", gap).withColumn("bare", F.rtrim("gap", F.lit(" \t\r\n")))
    before = F.when(F.col("bare") != "", F.right("bare", F.lit(1))).when(inner, F.substr("seg_text", F.col("last.e"), F.lit(1))).otherwise(F.col("prefix_end"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    rows = rows.withColumn("old_no", F.col("seg_no")).withColumn("shift", F.col("x.s"))
    moved = rows.withColumn("prefix_end", before).withColumn("at", F.col("start") + F.col("x.s")).withColumn("end", F.col("start") + F.col("x.e"))
    moved = moved.withColumn("seg_no", number).withColumn("start", F.col("at")).withColumn("seg_text", F.substr("seg_text", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")))
    return moved.withColumn("younger", F.coalesce(F.col("last.k") == F.col("x.k") - 1, F.lit(False))).select(*segments.columns, "younger", "old_no", "shift")


def moved(tokens: DataFrame, divided_rows: DataFrame) -> DataFrame:
    """Tokens of the pieces of ``divided``: numbered and placed anew; what hangs from a word of another piece is a root."""
    pieces = divided_rows.select("doc_id", "seg_no", "old_no", "shift", F.length("seg_text").alias("long"))
    own = tokens.withColumnRenamed("seg_no", "old_no").join(pieces, ["doc_id", "old_no"]).where("start >= shift AND start < shift + long")
    whole = Window.partitionBy("doc_id", "seg_no")
    own = own.withColumns({"least": F.min("i").over(whole), "most": F.max("i").over(whole)})
    head = F.when(F.col("head").between(F.col("least"), F.col("most")), F.col("head")).otherwise(F.col("i")) - F.col("least")
    return own.withColumn("head", head).withColumns({"i": F.col("i") - F.col("least"), "start": F.col("start") - F.col("shift")}).select(*tokens.columns)


def able(features: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, seg_no, can_conclude, can_condition of all segments: as the surface says, and as the parse does where there is one."""
    frags = fragments(tokens).select("doc_id", "seg_no", can_conclude(F.col("t")).alias("ends"), can_condition(F.col("t")).alias("begins"))
    both = features.select("doc_id", "seg_no", "can_conclude").join(frags, ["doc_id", "seg_no"], "left")
    return both.select("doc_id", "seg_no", (F.col("can_conclude") & F.coalesce("ends", F.lit(True))).alias("can_conclude"), F.coalesce("begins", F.lit(True)).alias("can_condition"))


def siblings(divided_rows: DataFrame) -> DataFrame:
    """doc_id, l, r: neighbours cut from one coordinated subordinate."""
    return divided_rows.where("younger").select("doc_id", (F.col("seg_no") - 1).alias("l"), F.col("seg_no").alias("r"))


def clause_commas(t: Column, unit: Column) -> Column:
    """Places after those commas and colons of a fragment that part clauses; unit: the sentence up to the fragment's end.

    Every mark parts clauses unless the fragment has two commas or more, its unit a
    condition, and the parse shows the comma inside a list, apposition or complement.
    """
    marks, words = F.filter(t, lambda x: x["text"].isin(",", ":")), _words(t)
    several = (F.size(F.filter(t, lambda x: x["text"] == ",")) >= 2) & has(unit, COMMA_CUE)
    conditional = has(F.concat_ws(" ", F.transform(t, lambda x: x["text"])), COMMA_HEAD)

    def internal(p: Column) -> Column:
        after = F.filter(words, lambda x: x["start"] > p["start"])
        first, second = F.get(after, F.lit(0)), F.get(after, F.lit(1))
        limit = F.array_min(F.transform(F.filter(marks, lambda m: m["start"] > p["start"]), lambda m: m["start"]))
        part = F.filter(after, lambda x: limit.isNull() | (x["start"] < limit))
        subjects = F.filter(part, lambda x: x["dep"].isin(SUBJECTS))
        pair = (second["pos"] == "SCONJ") | F.lower(second["text"]).isin("si", "lorsque", "quand", "comme")
        complement = limit.isNotNull() & first["pos"].isin("ADP", "ADJ") | (first["pos"] == "ADP") & (F.size(marks) >= 2)
        member = F.exists(F.slice(part, 1, 6), lambda x: x["pos"].isin("NOUN", "PROPN", "ADJ") & x["dep"].isin("conj", "appos"))
        predicate = limit.isNotNull() & F.exists(part, _finite) & (F.size(subjects) == 0) & conditional
        shared = F.exists(words, lambda a: (a["start"] < p["start"]) & a["dep"].isin(SUBJECTS) & F.exists(
            subjects, lambda s: (s["head"] == a["head"]) & _child(t, s, lambda c: c["dep"] == "conj")
        ))
        return (
            F.when((p["text"] == ":") | first.isNull() | F.lower(first["text"]).isin(EXCEPTIONS), False)
            .when(first["pos"] == "CCONJ", ~F.coalesce(pair, F.lit(False)))
            .otherwise(F.coalesce(complement | member | predicate | shared, F.lit(False)))
        )

    kept = F.filter(marks, lambda p: ~(F.coalesce(several, F.lit(False)) & internal(p)))
    return F.transform(kept, lambda p: p["start"] + F.length(p["text"]))


def subordinate_edges(frags: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, condition and conclusion (spans {start, end}): each adverbial clause with a subordinator, and the clause it hangs from without it."""
    t = F.col("t")
    one = frags.select(*keys, "t", F.explode(F.filter(t, lambda x: (x["dep"] == "advcl") & _child(t, x, lambda c: c["dep"] == "mark"))).alias("x"))
    under = lambda c, field: F.array_contains(c["up"], F.col(f"x.{field}"))
    spans = one.select(*keys, _span(F.filter(t, lambda c: under(c, "i"))).alias("condition"), _span(F.filter(t, lambda c: under(c, "head") & ~under(c, "i"))).alias("conclusion"))
    return spans.where("conclusion.start IS NOT NULL")


def overlapping(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, condition, conclusion (segment numbers) that spans of a whole text's edges fall on: an equi-join on the document, the overlap as its residue."""
    def falls(rows: DataFrame, side: str) -> DataFrame:
        s = segments.select(F.col("doc_id").alias("of"), F.col("seg_no").alias(f"{side}_no"), F.col("start").alias("s"), F.col("end").alias("e"))
        return rows.join(s, (F.col("doc_id") == F.col("of")) & (F.col(f"{side}.end") > F.col("s")) & (F.col(f"{side}.start") < F.col("e"))).drop("of", "s", "e")

    both = falls(falls(edges.select("doc_id", "condition", "conclusion"), "condition"), "conclusion")
    return both.where("condition_no <> conclusion_no").select("doc_id", F.col("condition_no").alias("condition"), F.col("conclusion_no").alias("conclusion")).distinct()


def truncated_connectors(segments: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, seg_no of short segments with a subordinator but neither subject nor finite verb in the parse of the whole text (token starts in the text). Texts without tokens have none."""
    short = segments.where(F.col("end") - F.col("start") <= LONGEST_CONNECTOR).where(has("seg_text", SUBORDINATOR)).select("doc_id", "seg_no", "start", "end")
    parsed = tokens.select("doc_id").distinct()
    proof = tokens.where(F.col("dep").isin(SUBJECTS) | _finite(F.struct("pos", F.coalesce("morph", F.lit("")).alias("morph")))).select(F.col("doc_id").alias("of"), F.col("start").alias("s"), (F.col("start") + F.length("text")).alias("e"))
    alone = short.join(parsed, "doc_id", "left_semi").join(proof, (F.col("doc_id") == F.col("of")) & (F.col("s") >= F.col("start")) & (F.col("e") <= F.col("end")), "left_anti")
    return alone.select("doc_id", "seg_no")


def joined_forward(segments: DataFrame, truncated: DataFrame) -> DataFrame:
    """doc_id, seg_no (from 1 again), start, end: truncated connectors joined to the next segment where only blanks, commas or colons lie between."""
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    flagged = segments.select("doc_id", "seg_no", "start", "end", "gap").join(truncated.select("doc_id", "seg_no", F.lit(True).alias("cut")), ["doc_id", "seg_no"], "left")
    carried = F.coalesce(F.lag("cut").over(w) & F.col("gap").rlike(rf"^[{cues.BLANKS},:]*$"), F.lit(False))
    islands = flagged.withColumn("carried", carried).withColumn("island", F.sum((~F.col("carried")).cast("int")).over(w))
    return islands.groupBy("doc_id", F.col("island").cast("int").alias("seg_no")).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def tense(frags: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, past (a root or what bears its tense is past), compound (a root has a tense auxiliary), dated (a word dates the event)."""
    t = F.col("t")
    past = F.exists(_roots(t), lambda r: _past(r) | _child(t, r, lambda c: c["dep"].isin(TENSE_BEARERS) & _past(c)))
    compound = F.exists(_roots(t), lambda r: _child(t, r, lambda c: c["dep"] == "aux:tense"))
    dated = F.exists(t, lambda x: x["dep"].isin(TIME_RELATIONS) & fold(x["lemma"]).isin(TIMES))
    return frags.select(*keys, past.alias("past"), compound.alias("compound"), dated.alias("dated"))


def singular_events(pairs: DataFrame, tenses: DataFrame) -> DataFrame:
    """pairs (doc_id, l, r) with singular: both past and one in a compound tense, or one of them dated. Without a parse of a side it is false."""
    side = lambda p: tenses.select("doc_id", F.col("seg_no").alias(p), F.struct("past", "compound", "dated").alias(f"{p}_of"))
    both = pairs.join(side("l"), ["doc_id", "l"], "left").join(side("r"), ["doc_id", "r"], "left")
    told = F.col("l_of.past") & F.col("r_of.past") & (F.col("l_of.compound") | F.col("r_of.compound"))
    known = F.col("l_of").isNotNull() & F.col("r_of").isNotNull()
    return both.withColumn("singular", F.coalesce(known & (told | F.col("l_of.dated") | F.col("r_of.dated")), F.lit(False))).drop("l_of", "r_of")


def logical_form(t: Column) -> Column:
    """A literal of a fragment: its verb over subject and objects, negated with "-", or the content words of a noun phrase; null if nothing is left."""
    root = F.get(_roots(t), F.lit(0))
    full = lambda xs: F.filter(xs, lambda x: x != "")
    content = F.filter(t, lambda x: x["pos"].isin("NOUN", "PROPN", "ADJ") & ~atom(x["text"]).isin(EMPTY_NOMINAL))
    nominal = F.nullif(F.left(F.array_join(full(F.transform(content, lambda x: atom(x["lemma"]))), "_"), F.lit(60)), F.lit(""))
    # a verb in the third person may carry the lemma of a noun ("applique"): the infinitive has an r
    lemma = F.coalesce(F.nullif(root["lemma"], F.lit("")), root["text"])
    bare = (root["pos"] == "VERB") & F.lower(lemma).endswith("e") & ~F.lower(lemma).endswith("re")
    head = atom(F.when(bare, F.concat(lemma, F.lit("r"))).otherwise(lemma))
    args = full(F.transform(F.filter(t, lambda x: _hangs(x, root) & x["dep"].isin("nsubj", "nsubj:pass", "obj", "dobj")), lambda x: atom(x["lemma"])))
    negated = F.exists(t, lambda x: F.array_contains(x["up"], root["i"]) & x["dep"].isin("advmod", "det") & atom(x["text"]).isin(NEGATIONS))
    literal = F.concat(F.when(negated, "-").otherwise(""), head, F.when(F.size(args) > 0, F.concat(F.lit("("), F.array_join(args, ", "), F.lit(")"))).otherwise(""))
    return F.when(root.isNull(), F.lit(None)).when(root["pos"].isin("VERB", "AUX"), F.when(head != "", literal)).otherwise(nominal)
