"""Edges premise -> conclusion that grammar alone proves, and what they support.

Segments of a document sit in one partition (one shuffle by doc_id); neighbours are
reached by window functions. Each rule adds an edge with its place in the order of
rules, so that the first edge that covers a pair decides it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argloom.functions import cues
from argloom.functions.text import fold, has

WINDOW = 6
#: Propositions looked at before and after a conclusion when support is asked for.
SUPPORT_BEFORE, SUPPORT_AFTER = 12, 3


def ranking_cue(folded):
    """The cue of a ranking in folded text: contiguous ones longest first, else comparatives; empty if none."""
    contiguous = "|".join(sorted(cues.RANKING_FOLDED, key=len, reverse=True))
    found = [F.regexp_extract(folded, rf"(?U)(?<!\w)(?:{c})(?!\w)", 0) for c in sorted(cues.RANKING_FOLDED, key=len, reverse=True)]
    any_contiguous = F.when(folded.rlike(rf"(?U)(?<!\w)(?:{contiguous})(?!\w)"), F.coalesce(*[F.nullif(x, F.lit("")) for x in found]))
    others = [F.nullif(F.regexp_extract(folded, f"(?U){p}", 0), F.lit("")) for p in (cues.COMPARATIVE_FOLDED, cues.ELIDED_WINNER_FOLDED, cues.ELIDED_LOSER_FOLDED)]
    return any_contiguous, F.coalesce(any_contiguous, *others, F.lit(""))


def featured(segments: DataFrame) -> DataFrame:
    """Segments with their flags; see the columns."""
    t, g = "seg_text", "gap"
    short = has(t, cues.SHORT_CIRCUMSTANCE) & (F.size(F.split(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), " ")) <= 6) & ~has(t, cues.ARTICULATION)
    folded = segments.withColumn("folded", fold(F.col(t)))
    contiguous, cue = ranking_cue(F.col("folded"))
    opens = F.col("prefix_end").isin("", ".", "!", "?")
    condition = has(t, cues.CONDITION)
    df = folded.withColumn("contiguous", contiguous).withColumn("cue", cue)
    df = df.select(
        "*", (F.col("cue") != "").alias("ranking"), condition.alias("condition"), (opens & (condition | short)).alias("detached"), (~(condition | short)).alias("can_conclude"),
        has(t, cues.NOMINAL_HEAD).alias("nominal"), has(t, cues.COORDINATED).alias("coordinated"), has(t, cues.RANKING_WITHOUT_RULE).alias("no_rule"),
        has(t, cues.CAUSE).alias("cause"), has(t, cues.INTRODUCED).alias("introduced"), has(t, cues.CONSEQUENCE).alias("consequence"), has(t, cues.TOPIC).alias("topic"),
        has(t, cues.DEMONSTRATIVE).alias("demonstrative"), has(t, cues.AGE).alias("age"), has(t, cues.THEN).alias("then"), has(t, cues.IN_THIS_CASE).alias("in_this_case"),
        ((F.col("seg_no") > 1) & has(g, cues.GAP_CONNECTOR)).alias("connector_gap"), has(g, cues.SAME_SENTENCE).alias("same_sentence_gap"), (F.trim(F.regexp_replace(g, r"(?U)\s+", " ")) == ",").alias("comma_gap"),
        F.col("folded").rlike(f"(?U){cues.RECALL_FOLDED}").alias("recall"),
    )
    df = df.withColumn("recall", ~F.col("ranking") & (F.col("recall") | F.col("consequence"))).withColumn("out_of_flow", F.col("ranking") | F.col("recall"))
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    tail = F.concat(F.right(F.lag(t).over(w), F.lit(12)), F.col(g))
    return df.withColumn("linked", F.coalesce(has(tail, cues.LINK), F.lit(False))).withColumn(
        "alternative", F.coalesce(has(tail, cues.OR_LINK) | F.col("nominal") & F.lag("nominal").over(w), F.lit(False))
    )


def edges(features: DataFrame) -> DataFrame:
    """doc_id, ord (place in the order of rules), condition, conclusion (segment numbers)."""
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda ok, frame: F.last(F.when(ok, F.col("seg_no")), ignorenulls=True).over(frame)
    nxt = {c: F.lead(c).over(w) for c in ("nominal", "coordinated", "no_rule", "cause", "age", "topic", "connector_gap", "same_sentence_gap", "comma_gap")}
    has_next, has_second = F.lead("seg_no").over(w).isNotNull(), F.lead("seg_no", 2).over(w).isNotNull()
    i = F.col("seg_no")
    rules = [
        (F.col("detached") & ~F.col("nominal") & ~nxt["coordinated"] & ~nxt["no_rule"], i, i + 1),
        (nxt["nominal"] & nxt["same_sentence_gap"], i + 1, F.coalesce(last(~F.col("nominal"), upto), F.lit(1))),
        (nxt["cause"] & nxt["same_sentence_gap"], i + 1, F.coalesce(last(~F.col("cause"), upto), F.lit(1))),
        (F.col("consequence") & (i > 1), last(~F.col("introduced"), earlier), i + 1),
        (nxt["connector_gap"] & ~nxt["age"] & ~F.col("no_rule"), i + 1, i),
        (nxt["comma_gap"] & nxt["topic"], i, i + 1),
        (has_second & F.col("condition") & nxt["coordinated"], i, i + 2),
        (has_second & F.col("condition") & nxt["coordinated"], i + 1, i + 2),
        (has_second & F.col("detached") & F.lead("then", 2).over(w), i, i + 2),
        (F.col("in_this_case") & (i > 1), i - 1, i + 1),
    ]
    found = F.array(*[F.when(has_next & ok & a.isNotNull(), F.struct((i * 100 + k).alias("ord"), a.cast("int").alias("condition"), b.cast("int").alias("conclusion"))) for k, (ok, a, b) in enumerate(rules)])
    run = F.sum((~F.col("linked")).cast("int")).over(upto)  # segments linked in a row share a number
    rows = features.select("doc_id", "seg_no", "demonstrative", run.alias("run"), F.filter(found, lambda x: x.isNotNull()).alias("found"))
    first = rows.select("doc_id", F.inline("found"))
    # a condition linked to an elder one has the elder's conclusions
    members = rows.select("doc_id", "seg_no", "run")
    chains = members.groupBy("doc_id", "run").agg(F.collect_list("seg_no").alias("members")).where(F.size("members") > 1)
    elder = chains.select("doc_id", F.explode("members").alias("condition"), "members")
    copied = first.join(elder, ["doc_id", "condition"]).select("doc_id", (F.lit(10**8) + F.col("ord")).alias("ord"), "conclusion", F.explode(F.filter("members", lambda m: m > F.col("condition"))).alias("condition"))
    both = first.unionByName(copied)
    # what takes up a conclusion has its condition
    resumes = rows.where("demonstrative").select("doc_id", F.col("seg_no").alias("resumed"))
    more = both.withColumn("resumed", F.greatest("condition", "conclusion") + 1).join(resumes, ["doc_id", "resumed"])
    return both.unionByName(more.select("doc_id", (F.lit(2 * 10**8) + F.col("ord")).alias("ord"), "condition", F.col("resumed").cast("int").alias("conclusion")))


def proofs(features: DataFrame, edge_rows: DataFrame, window: int = WINDOW, siblings: DataFrame | None = None) -> DataFrame:
    """doc_id, premise, conclusion of pairs within reach in one paragraph and speaker turn, as the first edge between them says. Siblings (doc_id, l, r) prove nothing of each other."""
    side = lambda p: features.select("doc_id", F.col("seg_no").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("paragraph", "speaker", "connector_gap", "age", "no_rule", "can_conclude", "out_of_flow")])
    suffixed = edge_rows.where("condition = conclusion + 1").select("doc_id", F.col("condition").alias("seg_no")).distinct().join(features.where("connector_gap").select("doc_id", "seg_no"), ["doc_id", "seg_no"]).select("doc_id", F.col("seg_no").alias("conclusion"))
    valid = (
        edge_rows.where(f"condition <> conclusion AND abs(condition - conclusion) <= {window}")
        .join(side("condition"), ["doc_id", "condition"]).join(side("conclusion"), ["doc_id", "conclusion"])
        .where("condition_paragraph = conclusion_paragraph AND condition_speaker = conclusion_speaker AND NOT conclusion_no_rule AND NOT (condition_age AND condition_connector_gap)")
        .join(suffixed, ["doc_id", "conclusion"], "left_anti")
    )
    pair = [F.least("condition", "conclusion").alias("l"), F.greatest("condition", "conclusion").alias("r")]
    valid = valid if siblings is None else valid.withColumns({"l": pair[0], "r": pair[1]}).join(siblings, ["doc_id", "l", "r"], "left_anti").drop("l", "r")
    best = valid.groupBy("doc_id", *pair).agg(F.min_by(F.struct("condition", "conclusion", "condition_out_of_flow", "conclusion_out_of_flow", "conclusion_can_conclude"), "ord").alias("e"))
    return best.select("doc_id", F.col("e.condition").alias("premise"), F.col("e.conclusion").alias("conclusion"), F.col("e.condition_out_of_flow").alias("premise_out"), F.col("e.conclusion_out_of_flow").alias("conclusion_out"), F.col("e.conclusion_can_conclude").alias("can_conclude"))


def grounds(features: DataFrame, proven: DataFrame, siblings: DataFrame | None = None) -> DataFrame:
    """doc_id, conclusion, premise of what stands: no alternatives of each other, conclusions that can conclude, mutual support broken in favour of the earlier premise. A premise brings its siblings (doc_id, l, r), but not its alternatives."""
    alternative = features.where("alternative").select("doc_id", (F.col("seg_no") - 1).alias("l"), F.col("seg_no").alias("r"))
    able = proven.where("NOT premise_out AND NOT conclusion_out AND can_conclude").withColumns({"l": F.least("premise", "conclusion"), "r": F.greatest("premise", "conclusion")})
    if siblings is None:
        return able.join(alternative, ["doc_id", "l", "r"], "left_anti").select("doc_id", "conclusion", "premise")
    stands = able.join(alternative.unionByName(siblings), ["doc_id", "l", "r"], "left_anti").select("doc_id", "conclusion", "premise")
    joint = siblings.join(alternative, ["doc_id", "l", "r"], "left_anti")
    both = joint.select("doc_id", F.col("l").alias("premise"), F.col("r").alias("other")).unionAll(joint.select("doc_id", "r", "l"))
    brought = stands.join(both, ["doc_id", "premise"]).select("doc_id", "conclusion", F.col("other").alias("premise"))
    return stands.unionByName(brought).distinct()


def candidate_pairs(propositions: DataFrame, window: int = WINDOW, keys: tuple[str, ...] = ("doc_id", "paragraph", "speaker")) -> DataFrame:
    """Unordered pairs of propositions within reach in one block: a window over the block, so the band costs O(window) a row."""
    reach = Window.partitionBy(*keys).orderBy("seg_no").rangeBetween(1, window)
    placed = propositions.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select(*keys, F.col("seg_no").alias("l"), F.collect_list("seg_no").over(reach).alias("r"))
    return placed.select(*keys, "l", F.explode("r").alias("r"))


def support_candidates(propositions: DataFrame, before: int = SUPPORT_BEFORE, after: int = SUPPORT_AFTER, keys: tuple[str, ...] = ("doc_id", "paragraph", "speaker")) -> DataFrame:
    """conclusion and each proposition that may support it: some before it and some after, in its block."""
    pairs = candidate_pairs(propositions, max(before, after), keys)
    way = lambda reach, c, p: F.when(F.col("r") - F.col("l") <= reach, F.struct(F.col(c).alias("conclusion"), F.col(p).alias("premise")))
    return pairs.select(*keys, F.explode(F.array(way(before, "r", "l"), way(after, "l", "r"))).alias("x")).where("x IS NOT NULL").select(*keys, "x.*")
