"""Registered queries of ways to say what supports what, over texts made from parts, and their SQL.

Each part is a document of one of the families (its key modulo their number); ``{n}``
stands for its name. A family lists its segments, each with the gap before it, and
those that support each of them; these lists alone make the texts and what must be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argloom.operators import graph
from argloom.plans.textgen import values

#: By family: (gap, text, premises), and what follows the last segment.
FAMILIES = [
    # a connector inside the sentence
    ([("", "Le train de {n} part", "2"), (" si ", "la voie est libre", "")], "."),
    # a topic that is taken up after a comma
    ([("", "Le client {n} attend longtemps", ""), (", ", "lui reçoit une remise", "1")], "."),
    # "alors" two segments later
    ([("", "Quand le stock {n} baisse", ""), (", ", "par ailleurs", "1"), (", ", "alors le dépôt commande des pièces", "1")], "."),
    # "dans ce cas" between two sentences
    ([("", "Le client {n} refuse la livraison", ""), (". ", "Dans ce cas", ""), (", ", "le dépôt reprend la marchandise", "1,2")], "."),
    # a condition linked to an elder one has the elder's conclusion
    ([("", "Le dépôt {n} accorde un rabais", "2,3"), (" si ", "le client est fidèle ou", ""), (" si ", "le prix monte", "")], "."),
    # a demonstrative goes on with a conclusion
    ([("", "Quand le stock {n} baisse", ""), (", ", "le dépôt commande des pièces", "1"), (". ", "Une telle commande retarde la livraison", "1")], "."),
    # if and then
    ([("", "Si le prix {n} monte", ""), (" alors ", "le client renonce", "1")], "."),
    # "chez" and "sans"
    ([("", "Chez les enfants {n}", ""), (" et ", "sans fièvre", ""), (", ", "le repos suffit", "1,2")], "."),
    # an insertion stays with what it is put into
    ([("", "Le service {n}, notamment le soir", ""), (", ", "ferme tôt", "")], "."),
    # conditions joined inside a sentence
    ([("", "Le dépôt {n} ferme à la condition que la route soit libre", ""), (" et à la condition que ", "le pont soit ouvert", "")], "."),
    # a ranking that leaves its loser out, and refines the one before
    (
        [
            ("", "Quand le client {n} commande", ""), (", ", "le dépôt livre la pièce", "1"), (". ", "Quand le client hésite", ""), (", ", "le dépôt garde le stock", "3"),
            (". ", "En hiver", ""), (", ", "la livraison de la pièce prime sur le stock gardé", ""), (". ", "Mais en été", ""), (", ", "le dépôt privilégie le stock gardé même en soirée", ""),
        ],
        ".",
    ),
]
RANKED = len(FAMILIES) - 1


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), "p_name")
    text = F.coalesce(*[F.when(F.col("doc_id") % len(FAMILIES) == k, F.lit("".join(g + t for g, t, _ in rows) + end)) for k, (rows, end) in enumerate(FAMILIES)])
    return graph.extract(parts.select("doc_id", F.replace(text, F.lit("{n}"), F.col("p_name")).alias("text")))


def phrased_grounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with what supports them."""
    made = _graph(spark, sf_dir)
    premises = made["grounds"].groupBy("doc_id", F.col("conclusion").alias("seg_no")).agg(F.array_join(F.array_sort(F.collect_set("premise")), ",").alias("premises"))
    return made["segments"].join(premises, ["doc_id", "seg_no"], "left").select("doc_id", "seg_no", "gap", "seg_text", F.coalesce("premises", F.lit("")).alias("premises"))


def phrased_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of the last family: the second takes the loser it leaves out from the first, and is preferred to it in summer."""
    made = _graph(spark, sf_dir)
    prefs = made["preferences"].select("doc_id", "pref_no", "winner", "loser", F.array_join("when_contexts", ",").alias("whens"))
    metas = made["meta_preferences"].select("doc_id", F.lit(0).alias("pref_no"), F.col("winner_pref").alias("winner"), F.col("loser_pref").alias("loser"), F.array_join("when_contexts", ",").alias("whens"))
    return prefs.unionByName(metas)


QUERIES = {f.__name__: f for f in (phrased_grounds, phrased_rankings)}

ORACLE_SQL = {
    "phrased_grounds": f"""SELECT p_partkey AS doc_id, CAST(seg_no AS INT) AS seg_no, gap, replace(template, '{{n}}', p_name) AS seg_text, premises
FROM part JOIN {values([(f, k + 1, *row) for f, (rows, _) in enumerate(FAMILIES) for k, row in enumerate(rows)], "family, seg_no, gap, template, premises")} ON p_partkey % {len(FAMILIES)} = family""",
    "phrased_rankings": f"""SELECT p_partkey AS doc_id, pref_no, winner, loser, whens FROM part
JOIN {values([(1, 2, 4, "5"), (2, 4, 2, "7"), (0, 2, 1, "7")], "pref_no, winner, loser, whens")} ON p_partkey % {len(FAMILIES)} = {RANKED}""",
}
