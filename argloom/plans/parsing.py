"""Registered queries of what needs a parse, over token tables made from the relational tables, and their SQL.

Each customer is a document of two fragments, of the families key modulo 5 and the one
after it; ``{n}`` stands for the customer's nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argloom.operators import parsed, scope

#: By family: (text before, text, lemma, part of speech, relation, head, features).
FAMILIES = [
    [
        ("", "le", "le", "DET", "det", 1, ""), (" ", "dépôt", "dépôt", "NOUN", "nsubj", 3, ""), (" ", "n'", "ne", "ADV", "advmod", 3, ""), ("", "accordait", "accorder", "VERB", "ROOT", 3, "Tense=Imp|VerbForm=Fin"),
        (" ", "jamais", "jamais", "ADV", "advmod", 3, ""), (" ", "un", "un", "DET", "det", 6, ""), (" ", "rabais", "rabais", "NOUN", "obj", 3, ""),
    ],
    [
        ("", "quand", "quand", "SCONJ", "mark", 4, ""), (" ", "le", "le", "DET", "det", 2, ""), (" ", "client", "client", "NOUN", "nsubj", 4, ""), (" ", "{n}", "{n}", "PROPN", "nmod", 2, ""),
        (" ", "paie", "payer", "VERB", "advcl", 8, "Tense=Pres|VerbForm=Fin"), ("", ",", ",", "PUNCT", "punct", 8, ""), (" ", "le", "le", "DET", "det", 7, ""), (" ", "dépôt", "dépôt", "NOUN", "nsubj", 8, ""),
        (" ", "demande", "demande", "VERB", "ROOT", 8, "Tense=Pres|VerbForm=Fin"),
    ],
    [("", "facture", "facture", "NOUN", "ROOT", 0, ""), (" ", "{n}", "{n}", "PROPN", "nmod", 0, ""), (" ", "impayée", "impayé", "ADJ", "amod", 0, "")],
    [("", "sauf", "sauf", "ADP", "case", 2, ""), (" ", "lorsque", "lorsque", "SCONJ", "mark", 2, ""), (" ", "pluie", "pluie", "NOUN", "ROOT", 2, ""), (" ", "{n}", "{n}", "PROPN", "nmod", 2, ""), (" ", "hier", "hier", "ADV", "advmod", 2, "")],
    [("", "la", "le", "DET", "det", 1, ""), (" ", "foudre", "foudre", "NOUN", "nsubj", 3, ""), (" ", "est", "être", "AUX", "aux:tense", 3, "Tense=Pres|VerbForm=Fin"), (" ", "tombée", "tomber", "VERB", "ROOT", 3, "Tense=Past|VerbForm=Part")],
]


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    rows = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("doc_id"), "n_name", F.explode(F.array(*[F.struct(F.lit(s).alias("seg_no"), ((key + s - 1) % len(FAMILIES)).alias("family")) for s in (1, 2)])).alias("f")
    )
    named = lambda x: F.replace(F.lit(x), F.lit("{n}"), F.col("n_name")) if "{n}" in x else F.lit(x)

    def family(words: list[tuple]) -> F.Column:
        out, at = [], F.lit(0)
        for before, text, lemma, pos, dep, head, morph in words:
            at = at + len(before)
            out.append(F.struct(F.lit(head).alias("head"), at.alias("start"), named(text).alias("text"), named(lemma).alias("lemma"), F.lit(pos).alias("pos"), F.lit(dep).alias("dep"), F.lit(morph).alias("morph")))
            at = at + F.length(named(text))
        return F.array(*out)

    made = F.coalesce(*[F.when(F.col("f.family") == k, family(words)) for k, words in enumerate(FAMILIES)])
    return rows.select("doc_id", "f.seg_no", F.posexplode(made).alias("i", "x")).select("doc_id", "seg_no", "i", "x.*")


BASE = f"""WITH f AS (SELECT c_custkey AS doc_id, n_name AS n, s.seg_no, (c_custkey + s.seg_no - 1) % {len(FAMILIES)} AS family
FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (SELECT * FROM (VALUES (1), (2)) AS v(seg_no)) AS s)
"""


def parsed_logical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed.fragments(tokens(spark, sf_dir)).select("doc_id", "seg_no", parsed.logical_form(F.col("t")).alias("literal"))


def parsed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, frags = F.col("t"), parsed.fragments(tokens(spark, sf_dir))
    told = parsed.tense(frags.select("*", parsed.opens_clause(t).alias("opens"), parsed.can_conclude(t).alias("concludes"), parsed.can_condition(t).alias("conditions")), ("doc_id", "seg_no", "opens", "concludes", "conditions"))
    return told


def parsed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = parsed.subordinate_edges(parsed.fragments(tokens(spark, sf_dir)))
    return edges.select("doc_id", "seg_no", *[F.col(f"{side}.{end}").alias(f"{side}_{end}") for side in ("condition", "conclusion") for end in ("start", "end")])


def singular_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenses = parsed.tense(parsed.fragments(tokens(spark, sf_dir)))
    pairs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("l"), F.lit(2).alias("r"))
    return parsed.singular_events(pairs, tenses).select("doc_id", "singular")


def nearby_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seg_no"), "l_returnflag")
    return scope.nearby(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag <> 'R'"), reach=2)


QUERIES = {f.__name__: f for f in (parsed_logical_forms, parsed_features, parsed_edges, singular_pairs, nearby_lines)}

ORACLE_SQL = {
    "parsed_logical_forms": BASE + """SELECT doc_id, seg_no, CASE family WHEN 0 THEN '-accorder(depot, rabais)' WHEN 1 THEN 'demander(depot)' WHEN 4 THEN 'tomber(foudre)'
WHEN 3 THEN left('pluie_' || trim(regexp_replace(lower(n), '[^a-z0-9]+', '_', 'g'), '_'), 60) ELSE left('facture_' || trim(regexp_replace(lower(n), '[^a-z0-9]+', '_', 'g'), '_') || '_impaye', 60) END AS literal FROM f""",
    "parsed_features": BASE + "SELECT doc_id, seg_no, family NOT IN (2, 3) AS opens, family <> 1 AS concludes, family <> 3 AS conditions, family IN (0, 4) AS past, family = 4 AS compound, family = 3 AS dated FROM f",
    "parsed_edges": BASE + """SELECT doc_id, seg_no, 0 AS condition_start, CAST(length(n) + 21 AS INT) AS condition_end, CAST(length(n) + 21 AS INT) AS conclusion_start, CAST(length(n) + 39 AS INT) AS conclusion_end
FROM f WHERE family = 1""",
    "singular_pairs": "SELECT c_custkey AS doc_id, c_custkey % 5 > 1 AS singular FROM customer",
    "nearby_lines": """SELECT DISTINCT a.l_orderkey AS doc_id, a.l_linenumber AS target, b.l_linenumber AS seg_no FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) <= 2 WHERE a.l_returnflag = 'R' AND b.l_returnflag <> 'R'""",
}
