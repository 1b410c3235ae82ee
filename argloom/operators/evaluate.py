"""Consequences of an argument graph under sets of active contexts.

The program is stratified: a rule applies if all its conditions are active; an active
preference defeats the conclusion of its loser if both rules apply; what is applicable
and not defeated is concluded. So there is one model, and plain set operations give it.
A document's rules and preferences sit in one row; each trial is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.functions.text import atom_id

#: Contexts up to which every subset is tried (4,096 trials), and trials beyond.
EXHAUSTIVE, SAMPLED = 12, 8


def atoms(entities: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and events with their identifiers as constants of a logic program, in references too."""
    roles = F.transform("roles", lambda r: F.struct(r["role"].alias("role"), atom_id(r["target"]).alias("target")))
    return entities.withColumn("ent_id", atom_id(F.col("ent_id"))), events.withColumns({"ev_id": atom_id(F.col("ev_id")), "trigger": atom_id(F.col("trigger")), "roles": roles})


def programs(entities: DataFrame, events: DataFrame) -> DataFrame:
    """doc_id, contexts, rules (id, option, conditions), prefs (id, winner, loser, condition), metas (winner, loser, condition)."""
    contexts = entities.where("kind = 'Context'").groupBy("doc_id").agg(F.sort_array(F.collect_set("ent_id")).alias("contexts"))
    of = lambda name: F.transform(F.filter("roles", lambda r: r["role"] == name), lambda r: r["target"])
    first = lambda name: F.get(of(name), F.lit(0))
    whens = F.transform(F.filter("roles", lambda r: r["role"] == "When"), lambda r: r["target"])
    pick = lambda kind, *cols: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct(*cols))))
    gathered = events.groupBy("doc_id").agg(
        pick("rule", F.col("ev_id").alias("id"), first("Effect").alias("option"), of("Condition").alias("conditions")).alias("rules"),
        pick("prefer", F.col("ev_id").alias("id"), first("Winner").alias("winner"), first("Loser").alias("loser"), whens.alias("whens")).alias("prefs"),
        pick("meta_prefer", first("Winner").alias("winner"), first("Loser").alias("loser"), whens.alias("whens")).alias("metas"),
    )
    return gathered.join(contexts, "doc_id", "left").withColumn("contexts", F.coalesce("contexts", F.expr("CAST(array() AS ARRAY<STRING>)")))


def trials(program: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, trial_no, regime, active: all subsets of the contexts, or all contexts and seeded draws where those would be too many."""
    n = F.size("contexts")
    every = F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), F.least(n, F.lit(EXHAUSTIVE))).cast("int") - 1), lambda mask: F.filter("contexts", lambda c, i: F.floor(mask / F.pow(F.lit(2), i)) % 2 == 1))
    draws = F.concat(F.array("contexts"), F.transform(F.sequence(F.lit(1), F.lit(SAMPLED - 1)), lambda k: F.filter("contexts", lambda c: F.pmod(F.xxhash64(c, k, F.lit(seed)), k + 1) == 0)))
    small = n <= EXHAUSTIVE
    return program.select("doc_id", F.when(small, "exhaustive").otherwise("sampled").alias("regime"), F.posexplode(F.when(small, every).otherwise(draws)).alias("trial_no", "active"))


def conclusions(program: DataFrame, tried: DataFrame, meta_effective: bool = False, all_whens: bool = False) -> DataFrame:
    """doc_id, trial_no, concluded (sorted options). By default only the first context of a preference counts and preferences between preferences change nothing; the flags make all count and let those neutralise."""
    df = tried.join(program, "doc_id")
    inside = lambda need: F.size(F.array_except(need, F.col("active"))) == 0
    holds = lambda whens: inside(whens if all_whens else F.slice(whens, 1, 1))
    df = df.withColumn("applied", F.filter("rules", lambda r: inside(r["conditions"])))
    ids = F.transform("applied", lambda r: r["id"])
    beaten = F.transform(F.filter("metas", lambda m: holds(m["whens"])), lambda m: m["loser"])
    df = df.withColumn("ids", ids).withColumn("beaten", beaten if meta_effective else F.expr("CAST(array() AS ARRAY<STRING>)"))
    active: Column = F.filter("prefs", lambda p: holds(p["whens"]) & F.array_contains("ids", p["winner"]) & F.array_contains("ids", p["loser"]) & ~F.array_contains("beaten", p["id"]))
    df = df.withColumn("defeated", F.transform(active, lambda p: p["loser"]))
    stands = F.filter("applied", lambda r: ~F.array_contains("defeated", r["id"]))
    return df.select("doc_id", "trial_no", F.array_sort(F.array_distinct(F.transform(stands, lambda r: r["option"]))).alias("concluded"))


def compare(reference: DataFrame, produced: DataFrame, **flags: bool) -> DataFrame:
    """Per document: trials, agreements, expected, given, common, precision, recall, f1; trials come from the reference."""
    tried = trials(reference)
    want, got = conclusions(reference, tried, **flags), conclusions(produced, tried, **flags)
    both = want.join(got.withColumnRenamed("concluded", "given"), ["doc_id", "trial_no"], "left").withColumn("given", F.coalesce("given", F.expr("CAST(array() AS ARRAY<STRING>)")))
    out = both.groupBy("doc_id").agg(
        F.count("*").alias("trials"), F.count_if(F.col("concluded") == F.col("given")).alias("agreements"), F.sum(F.size("concluded")).alias("expected"),
        F.sum(F.size("given")).alias("given"), F.sum(F.size(F.array_intersect("concluded", "given"))).alias("common"),
    )
    p, r = F.coalesce(F.try_divide("common", "given"), F.lit(0.0)), F.coalesce(F.try_divide("common", "expected"), F.lit(0.0))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
