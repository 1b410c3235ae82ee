"""What supports what, where grammar leaves it open: the questions to put to a model, and what stands of its replies.

Nothing is called from here. Replies are a table: doc_id, stage (labels, support,
relations, narrative), batch_no, ballot_no, payload. ``steps`` gives the questions of one
stage after the other to a caller who answers them, and the grounds that follow. ``run``
does so with one table of replies, which may answer some stages only; with no replies,
only what is proven stands.

Strategies: ``group`` asks which propositions support a conclusion and takes the reply;
``pairs`` asks for the direction of every pair within reach; ``hybrid`` asks for support
only of conclusions that no proof settles, then for the direction of the pairs that this
proposes. The last two then ask of each directed pair whether it merely narrates.

All is sets of pairs: a pair (doc_id, l, r) has l before r, a direction premise and conclusion.
"""

from __future__ import annotations

from collections.abc import Generator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argloom.operators import answers, relate, vote
from argloom.session import beside, cut

STRATEGIES = ("group", "pairs", "hybrid")
# Conclusions, and pairs, of one question.
SUPPORT_BATCH, PAIR_BATCH = 4, 10
PAIR = ["doc_id", "l", "r"]


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("l"), F.greatest(a, b).alias("r")]


def without(pairs: DataFrame, *others: DataFrame | None) -> DataFrame:
    for other in others:
        pairs = pairs if other is None else beside(pairs, other.select(*PAIR), PAIR, "anti")
    return pairs


def alternatives(features: DataFrame) -> DataFrame:
    """Neighbours of which the second is an alternative to the first."""
    return features.where("alternative").select("doc_id", (F.col("seg_no") - 1).alias("l"), F.col("seg_no").alias("r"))


def open_pairs(pairs: DataFrame, proven: DataFrame, singular: DataFrame | None = None) -> DataFrame:
    """Pairs whose direction is to be asked: not proven, and no singular events."""
    shown = proven.select("doc_id", *_pair("premise", "conclusion"))
    return without(pairs, shown, None if singular is None else singular.where("singular"))


def directed(pairs: DataFrame, proven: DataFrame, said: DataFrame) -> DataFrame:
    """doc_id, l, r, premise, conclusion, proven: pairs with the direction that a proof gives, else the one that was said (doc_id, l, r, value)."""
    shown = proven.select("doc_id", *_pair("premise", "conclusion"), "premise", "conclusion").withColumn("proven", F.lit(True))
    told = said.where("value IN ('A_TO_B', 'B_TO_A')").select(*PAIR, "value")
    both = beside(beside(pairs.select(*PAIR), shown, PAIR, "left"), told, PAIR, "left").where("proven OR value IS NOT NULL")
    ahead = F.col("value") == "A_TO_B"
    way = lambda side, a, b: F.when(F.col("proven"), F.col(side)).otherwise(F.when(ahead, F.col(a)).otherwise(F.col(b))).alias(side)
    return both.select(*PAIR, way("premise", "l", "r"), way("conclusion", "r", "l"), F.coalesce("proven", F.lit(False)).alias("proven"))


def refuted(directed_pairs: DataFrame, told: DataFrame) -> DataFrame:
    """Directed pairs that are proven or of which it was said (doc_id, l, r, value) that they do not narrate; without a reply a pair falls."""
    return beside(directed_pairs, told.where("value = 'N'").select(*PAIR, F.lit(True).alias("clear")), PAIR, "left").where("proven OR clear").drop("clear")


def pure(directed_pairs: DataFrame) -> DataFrame:
    """Where a premise of a conclusion is proven, its unproven ones fall."""
    settled = F.max("proven").over(Window.partitionBy("doc_id", "conclusion"))
    return directed_pairs.withColumn("settled", settled).where("proven OR NOT settled").drop("settled")


def with_siblings(directed_pairs: DataFrame, siblings: DataFrame) -> DataFrame:
    """doc_id, conclusion, premise: a proven premise brings its siblings (doc_id, l, r)."""
    both = siblings.select("doc_id", F.inline(F.array(*[F.struct(F.col(a).alias("premise"), F.col(b).alias("other")) for a, b in ("lr", "rl")])))
    others = both.groupBy("doc_id", "premise").agg(F.collect_set("other").alias("others"))
    own = F.array("premise")
    joint = beside(directed_pairs.select("doc_id", "conclusion", "premise", "proven"), others, ["doc_id", "premise"], "left")
    return joint.select("doc_id", "conclusion", F.explode(F.when(F.col("proven") & F.col("others").isNotNull(), F.concat(own, "others")).otherwise(own)).alias("premise")).distinct()


def one_way(ground_rows: DataFrame) -> DataFrame:
    """Of two that support each other, the earlier supports the later; nothing supports itself."""
    of_two, ahead = Window.partitionBy("doc_id", F.least("premise", "conclusion"), F.greatest("premise", "conclusion")), F.col("premise") < F.col("conclusion")
    return ground_rows.withColumn("forward", F.max(ahead).over(of_two)).where("premise <> conclusion AND (NOT forward OR premise < conclusion)").drop("forward")


def stands(directed_pairs: DataFrame, able: DataFrame, siblings: DataFrame | None = None, alternative: DataFrame | None = None) -> DataFrame:
    """doc_id, conclusion, premise of directed pairs after all guards: conclusions that can conclude and premises that can condition (able: doc_id, seg_no, can_conclude, can_condition), purity, siblings, one way."""
    ends = lambda side, flag: able.where(flag).select("doc_id", F.col("seg_no").alias(side))
    sound = beside(beside(directed_pairs, ends("conclusion", "can_conclude"), ["doc_id", "conclusion"], "semi"), ends("premise", "can_condition"), ["doc_id", "premise"], "semi")
    kept = pure(sound)
    joint = kept.select("doc_id", "conclusion", "premise") if siblings is None else with_siblings(kept, without(siblings, alternative))
    return one_way(joint)


# --- questions


def pair_questions(pairs: DataFrame, size: int = PAIR_BATCH) -> DataFrame:
    """doc_id, batch_no, item (from 1 in a batch), l, r: pairs in order, so many a question."""
    numbered = pairs.select(*PAIR).withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("l", "r")) - 1)
    return numbered.select("doc_id", F.floor(F.col("at") / size).cast("int").alias("batch_no"), (F.col("at") % size + 1).alias("item"), "l", "r")


def support_questions(conclusions: DataFrame, propositions: DataFrame, size: int = SUPPORT_BATCH) -> DataFrame:
    """doc_id, batch_no, examined, candidates: conclusions (doc_id, seg_no), so many a question, with the propositions (doc_id, paragraph, speaker, seg_no) that may support any of them."""
    asked = vote.batches(conclusions.select("doc_id", F.col("seg_no").alias("item")), size, ["doc_id"])
    near = relate.support_candidates(propositions).select("doc_id", F.col("conclusion").alias("item"), "premise")
    offered = beside(near, asked, ["doc_id", "item"]).groupBy("doc_id", "batch_no").agg(F.collect_set("premise").alias("near"))
    own = beside(asked, propositions.select("doc_id", F.col("seg_no").alias("item"), F.col("seg_no").alias("own")), ["doc_id", "item"], "left")
    examined = own.groupBy("doc_id", "batch_no").agg(F.sort_array(F.collect_list("item")).alias("examined"), F.collect_set("own").alias("own"))
    candidates = F.when(F.col("near").isNull(), F.col("own")).otherwise(F.array_union("own", "near"))
    both = beside(examined, offered, ["doc_id", "batch_no"], "left").select("doc_id", "batch_no", "examined", F.sort_array(candidates).alias("candidates"))
    return both.where("size(candidates) > 0")


def presented(questions: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, batch_no, item, a, b, passage of pair questions: both texts, and all from the first to the second. Segments (doc_id, seg_no, gap, seg_text) meet a pair by their numbers."""
    inside = questions.select("doc_id", "batch_no", "item", "l", "r", F.explode(F.sequence("l", "r")).alias("seg_no")).join(segments.select("doc_id", "seg_no", "gap", "seg_text"), ["doc_id", "seg_no"])
    piece = F.struct("seg_no", F.when(F.col("seg_no") == F.col("l"), F.lit("")).otherwise(F.col("gap")).alias("gap"), "seg_text")
    run = inside.groupBy("doc_id", "batch_no", "item").agg(F.array_sort(F.collect_list(piece)).alias("run"))
    passage = F.array_join(F.transform("run", lambda x: F.concat(x["gap"], x["seg_text"])), "")
    return run.select("doc_id", "batch_no", "item", F.get("run", F.lit(0))["seg_text"].alias("a"), F.element_at("run", -1)["seg_text"].alias("b"), passage.alias("passage"))


def _votes(replies: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """Replies of a stage, and the number of ballots held of each question."""
    own = replies.where(F.col("stage") == stage)
    return own, own.groupBy("doc_id", "batch_no").agg(F.count_distinct("ballot_no").alias("ballots"))


def voted_pairs(questions: DataFrame, replies: DataFrame, stage: str) -> DataFrame:
    """doc_id, l, r, value that most ballots give to a pair question; without a majority NONE, or Y where narration is asked."""
    own, _ = _votes(replies, stage)
    read, otherwise = (answers.relations, "NONE") if stage == "relations" else (answers.narratives, "Y")
    said = vote.majority(read(own), ["doc_id", "batch_no", "item"], fallback=otherwise)
    return beside(questions, said, ["doc_id", "batch_no", "item"]).select(*PAIR, "value")


def voted_support(questions: DataFrame, propositions: DataFrame, replies: DataFrame) -> DataFrame:
    """doc_id, conclusion, premise: what most ballots name as support of an examined conclusion, propositions only."""
    held = F.size(F.collect_set("ballot_no").over(Window.partitionBy("doc_id", "batch_no")))  # unreadable ballots too; replies are read once
    own = answers.support(replies.where("stage = 'support'").withColumn("ballots", held), "ballots")
    named = own.select("doc_id", "batch_no", "ballot_no", "ballots", "item", F.explode("grounds").alias("value"))
    tally = named.groupBy("doc_id", "batch_no", "item", "value").agg(F.size(F.collect_set("ballot_no")).alias("n"), F.max("ballots").alias("ballots"))
    asked = questions.select("doc_id", "batch_no", F.explode("examined").alias("item"))
    premises = propositions.select("doc_id", F.col("seg_no").alias("premise"))
    won = tally.where("n * 2 > ballots").select("doc_id", "batch_no", "item", F.col("value").alias("premise")).where("premise <> item")
    found = beside(won, asked, ["doc_id", "batch_no", "item"], "semi").select("doc_id", F.col("item").alias("conclusion"), "premise")
    return beside(found, premises, ["doc_id", "premise"], "semi").select("doc_id", "conclusion", "premise").distinct()


def labelled(features: DataFrame, replies: DataFrame) -> DataFrame:
    """doc_id, seg_no of segments that most ballots call propositions."""
    own, held = _votes(replies, "labels")
    tags = vote.majority_tags(answers.labels(own), ["doc_id", "batch_no", "item"], held=held)
    said = tags.where(F.array_contains("tags", "P")).select("doc_id", F.col("item").alias("seg_no")).distinct()
    return features.select("doc_id", "seg_no").join(said, ["doc_id", "seg_no"], "left_semi")


def voted_enumerations(replies: DataFrame) -> DataFrame:
    """doc_id, seg_no, items: enumerations that more than half of the ballots held give alike."""
    own, held = _votes(replies, "enumerations")
    read = answers.enumerations(own).select("doc_id", "batch_no", "ballot_no", "item", F.col("items").alias("value"))
    won = vote.majority_support(read, held, ["doc_id", "batch_no", "item"])
    return won.groupBy("doc_id", F.col("item").alias("seg_no")).agg(F.min("value").alias("items"))


def steps(
    features: DataFrame, propositions: DataFrame, proven: DataFrame, strategy: str = "hybrid", siblings: DataFrame | None = None, singular_of=None, able: DataFrame | None = None, keep=cut,
) -> Generator[tuple[str, DataFrame], DataFrame, None]:
    """Yields each stage (support, relations, narrative) with its questions, takes the replies to them, and at last yields "grounds" (doc_id, conclusion, premise).

    propositions: doc_id, seg_no. singular_of: pairs -> pairs with ``singular`` (see
    ``parsed.singular_events``). able: doc_id, seg_no, can_conclude, can_condition; by
    default what the surface says. Each stage is worked out once and held by ``keep``; with
    ``session.dealt`` over all tables by doc_id no stage is shuffled.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    if able is None:
        able = features.select("doc_id", "seg_no", "can_conclude", F.lit(True).alias("can_condition"))
    placed = keep(beside(features.select("doc_id", "paragraph", "speaker", "seg_no"), propositions, ["doc_id", "seg_no"], "semi"))
    block = lambda side: features.select("doc_id", F.col("seg_no").alias(side), F.struct("paragraph", "speaker").alias(f"{side}_block"))
    either = alternatives(features)
    proofs = without(proven.select("doc_id", *_pair("premise", "conclusion"), "premise", "conclusion"), siblings, either)
    if strategy == "pairs":
        pairs = relate.candidate_pairs(placed).select(*PAIR)
    else:
        examined = placed.select("doc_id", "seg_no")
        if strategy == "hybrid":
            sound = beside(proofs, able.where("can_conclude").select("doc_id", F.col("seg_no").alias("conclusion")), ["doc_id", "conclusion"], "semi")
            sound = beside(sound, able.where("can_condition").select("doc_id", F.col("seg_no").alias("premise")), ["doc_id", "premise"], "semi")
            settled = sound.select("doc_id", F.explode(F.array("premise", "conclusion")).alias("seg_no"))
            examined = beside(beside(examined, settled, ["doc_id", "seg_no"], "anti"), able.where("can_conclude"), ["doc_id", "seg_no"], "semi")
        asked = keep(support_questions(examined, placed))
        proposed = voted_support(asked, placed, (yield "support", asked))
        if strategy == "group":
            yield "grounds", one_way(proposed)
            return
        named = proposed.select("doc_id", *_pair("premise", "conclusion")).distinct()
        same = beside(beside(named, block("l"), ["doc_id", "l"]), block("r"), ["doc_id", "r"]).where("l_block = r_block").select(*PAIR)
        pairs = same.unionByName(proofs.select(*PAIR)).distinct()
    pairs = keep(without(pairs, siblings, either))
    left = open_pairs(pairs, proofs, None if singular_of is None else singular_of(pairs))
    asked = keep(pair_questions(left))
    way = keep(directed(pairs, proofs, voted_pairs(asked, (yield "relations", asked), "relations")))
    asked = keep(pair_questions(way.where("NOT proven")))
    kept = refuted(way, voted_pairs(asked, (yield "narrative", asked), "narrative"))
    yield "grounds", stands(kept, able, siblings, either)


def run(features: DataFrame, propositions: DataFrame, proven: DataFrame, replies: DataFrame, *args, **options) -> dict[str, DataFrame]:
    """All that ``steps`` yields, with one table of replies to the questions of all stages."""
    going, out = steps(features, propositions, proven, *args, **options), {}
    stage, found = next(going)
    while stage != "grounds":
        out[stage] = found
        stage, found = going.send(replies)
    return out | {stage: found}


def costs(asked: dict[str, DataFrame]) -> DataFrame:
    """doc_id, stage, questions, items: what the stages of ``steps`` ask."""
    size = {"support": F.size("examined"), "relations": F.lit(1), "narrative": F.lit(1)}
    rows = [asked[s].select("doc_id", F.lit(s).alias("stage"), "batch_no", size[s].alias("n")) for s in size if s in asked]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("doc_id", "stage").agg(F.count_distinct("batch_no").alias("questions"), F.sum("n").alias("items"))
