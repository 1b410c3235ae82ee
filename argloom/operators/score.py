"""Scores of produced graphs against reference graphs, both as entity and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argloom.session import cut

KINDS = ("Context", "Option", "Marker")


def alignment(produced: DataFrame, reference: DataFrame, least: float = 0.5, strict: bool = False) -> DataFrame:
    """doc_id, ent_id, ref_id: entities of one kind paired greedily by overlap (intersection over hull), best first, ties by id."""
    p = produced.select("doc_id", "kind", "ent_id", "start", "end")
    r = reference.select("doc_id", "kind", F.col("ent_id").alias("ref_id"), F.col("start").alias("s"), F.col("end").alias("e"))
    common = F.greatest(F.lit(0), F.least("end", "e") - F.greatest("start", "s"))
    score = F.when(common > 0, common / (F.greatest("end", "e") - F.least("start", "s"))).otherwise(0.0)
    score = F.when((F.col("start") == F.col("s")) & (F.col("end") == F.col("e")), 1.0).otherwise(0.0) if strict else score
    pairs = p.join(r, ["doc_id", "kind"]).withColumn("score", score).where(F.col("score") >= (1.0 if strict else least))
    ordered = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "ent_id", "ref_id"))).alias("pairs"))
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["ent_id"] == x["ent_id"]) | (t["ref_id"] == x["ref_id"]))
    greedy = F.aggregate("pairs", F.expr("CAST(array() AS ARRAY<STRUCT<ent_id: STRING, ref_id: STRING>>)"), lambda a, x: F.when(free(a, x), F.array_append(a, F.struct(x["ent_id"].alias("ent_id"), x["ref_id"].alias("ref_id")))).otherwise(a))
    return ordered.select("doc_id", F.inline(greedy))


def signatures(events: DataFrame, names: DataFrame | None = None, anchors: bool = True) -> DataFrame:
    """doc_id, ev_id, kind, signature: events in terms of reference entities (names: doc_id, ent_id, ref_id; itself if none). Events that do not translate are left out."""
    role = events.select("doc_id", "ev_id", "kind", F.explode("roles").alias("r")).select("doc_id", "ev_id", "kind", "r.role", "r.target")
    if names is None:
        role = role.withColumn("to", F.col("target"))
    else:
        role = role.join(names.select("doc_id", F.col("ent_id").alias("target"), F.col("ref_id").alias("to")), ["doc_id", "target"], "left")
    gathered = role.groupBy("doc_id", "ev_id", "kind").agg(
        F.min_by(F.when(F.col("role") == "Effect", F.col("to")), F.when(F.col("role") == "Effect", F.lit(0))).alias("effect"),
        F.count_if(F.col("role").isin("Condition", "When") & F.col("to").isNull()).alias("lost"),
        F.sort_array(F.collect_set(F.when(F.col("role").isin("Condition", "When"), F.col("to")))).alias("places"),
        F.first(F.when(F.col("role") == "Winner", F.col("target")), ignorenulls=True).alias("winner"), F.first(F.when(F.col("role") == "Loser", F.col("target")), ignorenulls=True).alias("loser"),
    )
    rules = gathered.where("kind = 'rule' AND effect IS NOT NULL AND lost = 0").select("doc_id", "ev_id", "kind", F.concat_ws("|", F.lit("rule"), "effect", F.array_join("places", ",")).alias("signature"))
    ranks = cut(gathered.where("kind IN ('prefer', 'meta_prefer')").where("lost = 0" if anchors else "true"))
    side = lambda name, of: of.select("doc_id", F.col("ev_id").alias(name), F.col("signature").alias(f"{name}_signature"))
    when = F.array_join("places", ",") if anchors else F.lit("")
    done = cut(rules)
    while True:  # one level of rankings between rankings a round; those in cycles are never signed
        ranked = ranks.join(done.select("doc_id", "ev_id"), ["doc_id", "ev_id"], "left_anti").join(side("winner", done), ["doc_id", "winner"]).join(side("loser", done), ["doc_id", "loser"])
        level = cut(ranked.select("doc_id", "ev_id", "kind", F.concat_ws("|", "kind", F.concat(F.lit("("), "winner_signature", F.lit(")")), F.concat(F.lit("("), "loser_signature", F.lit(")")), when).alias("signature")))
        if level.isEmpty():
            break
        done = done.unionByName(level)
    return done


def bag_counts(produced: DataFrame, reference: DataFrame) -> DataFrame:
    """doc_id, kind, correct, given, expected of signatures, each counted as often as it occurs."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "kind", "signature").orderBy("ev_id"))
    p = produced.select("doc_id", "kind", "signature", nth.alias("k")).withColumn("given", F.lit(1))
    r = reference.select("doc_id", "kind", "signature", nth.alias("k")).withColumn("expected", F.lit(1))
    both = p.join(r, ["doc_id", "kind", "signature", "k"], "full").groupBy("doc_id", "kind")
    return both.agg(F.count_if(F.col("given").isNotNull() & F.col("expected").isNotNull()).alias("correct"), F.count("given").alias("given"), F.count("expected").alias("expected"))


def entity_counts(produced: DataFrame, reference: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, kind, correct, given, expected of entities."""
    right = produced.join(names.select("doc_id", "ent_id", "ref_id"), ["doc_id", "ent_id"], "left")
    p = right.groupBy("doc_id", "kind").agg(F.count("ref_id").alias("correct"), F.count("*").alias("given"))
    r = reference.groupBy("doc_id", "kind").agg(F.count("*").alias("expected"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.join(r, ["doc_id", "kind"], "full").select("doc_id", "kind", zero("correct"), zero("given"), zero("expected"))


def score(produced: tuple[DataFrame, DataFrame], reference: tuple[DataFrame, DataFrame], strict: bool = False) -> DataFrame:
    """doc_id, kind, correct, given, expected for entity kinds, event kinds, and rankings without their contexts ("unanchored")."""
    names = alignment(produced[0], reference[0], strict=strict)
    events = bag_counts(signatures(produced[1], names), signatures(reference[1]))
    loose = lambda s: s.where("kind <> 'rule'").withColumn("kind", F.lit("unanchored"))
    unanchored = bag_counts(loose(signatures(produced[1], names, anchors=False)), loose(signatures(reference[1], anchors=False)))
    return entity_counts(produced[0], reference[0], names).unionByName(events).unionByName(unanchored)


def ratios(counts: DataFrame, *by: str) -> DataFrame:
    """Micro precision, recall and F1 of counts, by the columns named; nothing expected and nothing given is perfect."""
    return with_ratios(counts.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("correct", "given", "expected")]))


def with_ratios(total: DataFrame) -> DataFrame:
    p = F.when(F.col("given") > 0, F.col("correct") / F.col("given")).when(F.col("expected") == 0, 1.0).otherwise(0.0)
    r = F.when(F.col("expected") > 0, F.col("correct") / F.col("expected")).otherwise(1.0)
    return total.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def report(counts: DataFrame, corpora: DataFrame) -> DataFrame:
    """corpus, doc_id, kind and ratios: of every document, of every corpus (doc_id null) and of all (both null), in one aggregation. corpora: doc_id, corpus. Besides the kinds, "entities" and "priorities" (both kinds of rankings) are told."""
    more = F.when(F.col("kind").isin(*KINDS), F.array("kind", F.lit("entities"))).when(F.col("kind").isin("prefer", "meta_prefer"), F.array("kind", F.lit("priorities"))).otherwise(F.array("kind"))
    told = counts.join(corpora, "doc_id").select("corpus", "doc_id", F.explode(more).alias("kind"), "correct", "given", "expected")
    sets = told.groupingSets([["corpus", "doc_id", "kind"], ["corpus", "kind"], ["kind"]], "corpus", "doc_id", "kind")
    total = sets.agg(*[F.sum(c).cast("long").alias(c) for c in ("correct", "given", "expected")])
    return with_ratios(total)


def causes_of_entities(produced: DataFrame, reference: DataFrame, names: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, ent_id, fault (invented or missed), cause of entities without a partner: ``boundary`` if one of their kind overlaps, ``kind`` if one of another does, else ``absent``.

    Spans meet by the buckets of ``reach`` characters that they touch, so a span is
    compared with those near it only.
    """
    def touching(df: DataFrame, name: str) -> DataFrame:
        part = df.select("doc_id", F.col("ent_id").alias(name), F.col("kind").alias(f"{name}_kind"), F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"))
        return part.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{name}_start") / reach), F.floor(F.greatest(F.col(f"{name}_end") - 1, F.col(f"{name}_start")) / reach))))

    def side(own: DataFrame, other: DataFrame, fault: str) -> DataFrame:
        met = touching(own, "a").join(touching(other, "b"), ["doc_id", "bucket"]).where("a_start < b_end AND b_start < a_end")
        best = met.groupBy("doc_id", F.col("a").alias("ent_id")).agg(F.max(F.when(F.col("a_kind") == F.col("b_kind"), 2).otherwise(1)).alias("near"))
        why = F.when(F.col("near") == 2, "boundary").when(F.col("near") == 1, "kind").otherwise("absent")
        return own.select("doc_id", "ent_id").join(best, ["doc_id", "ent_id"], "left").select("doc_id", "ent_id", F.lit(fault).alias("fault"), why.alias("cause"))

    invented = produced.join(names.select("doc_id", "ent_id"), ["doc_id", "ent_id"], "left_anti")
    missed = reference.join(names.select("doc_id", F.col("ref_id").alias("ent_id")), ["doc_id", "ent_id"], "left_anti")
    return side(invented, reference, "invented").unionByName(side(missed, produced, "missed"))


def causes_of_rules(produced: DataFrame, reference: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, ev_id, cause of reference rules (events) that no produced rule equals: ``effect`` if none concludes the same, else ``conditions``."""
    got, want = signatures(produced, names).where("kind = 'rule'"), signatures(reference).where("kind = 'rule'")
    effect = F.get(F.split("signature", r"\|"), F.lit(1)).alias("effect")
    missed = want.join(got.select("doc_id", "signature").distinct(), ["doc_id", "signature"], "left_anti").select("doc_id", "ev_id", effect)
    target = produced.where("kind = 'rule'").select("doc_id", F.explode("roles").alias("r")).where("r.role = 'Effect'").select("doc_id", F.col("r.target").alias("ent_id"))
    concluded = target.join(names, ["doc_id", "ent_id"]).select("doc_id", F.col("ref_id").alias("effect")).distinct().withColumn("near", F.lit(True))
    return missed.join(concluded, ["doc_id", "effect"], "left").select("doc_id", "ev_id", F.when(F.col("near"), "conditions").otherwise("effect").alias("cause"))


def pollution(negatives: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """One row: documents that should be empty, how many are not, and events invented in them."""
    own = negatives.select("doc_id").distinct()
    hit = own.join(entities.select("doc_id").unionAll(events.select("doc_id")).distinct(), "doc_id", "left_semi").agg(F.count("*").alias("polluted"))
    made = events.join(own, "doc_id", "left_semi").agg(F.count("*").alias("invented"))
    return own.agg(F.count("*").alias("documents")).join(hit).join(made)


def unmatched(produced: DataFrame, reference: DataFrame, top: int = 30) -> DataFrame:
    """The most frequent signatures that were produced and not expected, or expected and not produced."""
    keys = ["doc_id", "kind", "signature"]
    wrong = produced.select(keys).exceptAll(reference.select(keys)).withColumn("fault", F.lit("invented"))
    missed = reference.select(keys).exceptAll(produced.select(keys)).withColumn("fault", F.lit("missed"))
    return wrong.unionByName(missed).groupBy("fault", "kind", "signature").count().orderBy(F.desc("count"), "fault", "signature").limit(top)
