"""Registered queries of the argument-graph engine, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from argloom.functions import aligned, cues, text
from argloom.operators import evaluate, graph, relate, scope, score, vote
from argloom.operators.segment import segments
from argloom.plans import parsing, phrasings, replies
from argloom.plans.textgen import corpus, expected_sql, graphs
from argloom.session import shared_dir
from argloom.sources import brat
from argloom.sources import corpus as corpora

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = parsing.QUERIES | replies.QUERIES | phrasings.QUERIES
ORACLE_SQL: dict[str, str] = parsing.ORACLE_SQL | replies.ORACLE_SQL | phrasings.ORACLE_SQL


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def roles_text() -> Column:
    return F.array_join(F.transform("roles", lambda r: F.concat(r["role"], F.lit(":"), r["target"])), " ")


# --- the flagship: rules with the text of their conditions and conclusion


@query(expected_sql("""
SELECT r.doc_id, CAST(r.rule_no AS INT) AS rule_no, string_agg(c.seg_text, ' & ' ORDER BY c.seg_no) AS conditions, max(e.seg_text) AS conclusion
FROM (SELECT doc_id, rule_no, conclusion, unnest(conditions) AS premise FROM docs JOIN rule_x USING (family)) r
JOIN seg c ON c.doc_id = r.doc_id AND c.seg_no = r.premise JOIN seg e ON e.doc_id = r.doc_id AND e.seg_no = r.conclusion GROUP BY r.doc_id, r.rule_no"""))  # fmt: skip
def rules_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs(spark, sf_dir)
    seg = g["features"].select("doc_id", "seg_no", "seg_text")
    premises = g["rules"].select("doc_id", "rule_no", "conclusion", F.explode("conditions").alias("seg_no")).join(seg, ["doc_id", "seg_no"])
    listed = premises.groupBy("doc_id", "rule_no", "conclusion").agg(F.sort_array(F.collect_list(F.struct("seg_no", "seg_text"))).alias("x"))
    of = seg.select("doc_id", F.col("seg_no").alias("conclusion"), F.col("seg_text").alias("conclusion_text"))
    return listed.join(of, ["doc_id", "conclusion"]).select("doc_id", "rule_no", F.array_join(F.transform("x", lambda r: r["seg_text"]), " & ").alias("conditions"), F.col("conclusion_text").alias("conclusion"))


# --- segmentation


@query(expected_sql('SELECT doc_id, CAST(seg_no AS INT) AS seg_no, start, "end", seg_text FROM seg'))
def segment_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(corpus(spark, sf_dir)).select("doc_id", "seg_no", "start", "end", "seg_text")


@query()
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(table(spark, sf_dir, "documents"))


@query("""
SELECT p_partkey, repeat(' ', length(CAST(p_partkey % 100 AS VARCHAR)) + 1) || ' ' || p_name || chr(10) || '   second ' || p_brand || '.' || chr(10) || '     ' || p_type AS neutral FROM part""")
def enumerations_neutralised(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = F.concat((F.col("p_partkey") % 100).cast("string"), F.lit(") "), "p_name", F.lit("\nb. second "), "p_brand", F.lit(".\n iv) "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.neutralise_enumerations(numbered).alias("neutral"))


@query("""
WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'ANNA' ELSE 'BORIS' END AS who FROM conversations WHERE turn IS NOT NULL),
s AS (SELECT conv_id, who, min(turn) AS first FROM t GROUP BY ALL)
SELECT DISTINCT t.conv_id, t.turn, CAST((SELECT count(*) FROM s WHERE s.conv_id = t.conv_id AND s.first < me.first) AS INT) AS speaker, CAST(count(*) OVER (PARTITION BY t.conv_id ORDER BY t.turn) - 1 AS INT) AS paragraph
FROM t JOIN s me ON me.conv_id = t.conv_id AND me.who = t.who""")
def paragraphs_and_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.when(F.col("role") == "user", "ANNA").otherwise("BORIS")
    turns = table(spark, sf_dir, "conversations").where("turn IS NOT NULL").select("conv_id", "turn", F.concat(who, F.lit(". tour numero x"), F.col("turn").cast("string"), F.lit(" du dialogue")).alias("line"))
    docs = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n\n").alias("text"))
    found = segments(docs, doc_id="conv_id")
    return found.select(F.col("doc_id").alias("conv_id"), F.regexp_extract("seg_text", r"x(\d+)", 1).cast("long").alias("turn"), "speaker", "paragraph").where("turn IS NOT NULL").distinct()


@query("""
WITH lines AS (SELECT c_custkey, unnest(range(2 + c_custkey % 3)) AS n FROM customer)
SELECT c_custkey AS doc_id, CAST(n + 1 AS INT) AS seg_no, CAST(n AS INT) AS block, 'Le client ' || c_custkey || ' attend ' || n AS seg_text FROM lines""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, breaks = F.col("c_custkey"), F.repeat(F.lit("\n"), (F.col("c_custkey") % 4 + 1).cast("int"))
    lines = F.transform(F.sequence(F.lit(0).cast("long"), key % 3 + 1), lambda n: F.concat(F.lit("Le client "), key.cast("string"), F.lit(" attend "), n.cast("string")))
    found = segments(table(spark, sf_dir, "customer").select(key.alias("doc_id"), F.array_join(F.transform(lines, lambda x: F.concat(x, breaks)), "").alias("text")))
    return found.select("doc_id", "seg_no", "seg_text").join(scope.blocks(found), ["doc_id", "seg_no"])


# --- scalar functions


@query("SELECT n_nationkey, lower(n_name) AS folded, regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g') AS atom FROM nation")
def folded_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    accented = F.translate("n_name", "AEIOU", "ÀÉÎÔÜ")
    return table(spark, sf_dir, "nation").select("n_nationkey", text.fold(accented).alias("folded"), text.atom(accented).alias("atom"))


@query("""
SELECT p_partkey, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 3), lambda w: left(w, 5)))), ','), '') AS stems FROM part""")
def stems_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", joined(F.sort_array(text.stems(F.regexp_replace("p_name", "[^A-Za-z ]", " ")))).alias("stems"))


@query("""
SELECT event_id, length(props) > 0 AS has_payload, substr(props, strpos(props, '{')) AS payload, event_type IN ('yes') OR upper(left(trim(event_type), 1)) IN ('Y', 'O', '1', 'T') AS truthy FROM events WHERE props IS NOT NULL AND props LIKE '{%}'""")
def model_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("<think>no {x} here</think> ```json\n"), "props", F.lit("\n``` "))
    events = table(spark, sf_dir, "events").where("props LIKE '{%}'")
    return events.select("event_id", (F.length("props") > 0).alias("has_payload"), text.json_payload(reply).alias("payload"), text.truthy(F.col("event_type")).alias("truthy"))


@query("SELECT s_suppkey, CAST(length('Le fournisseur ') AS INT) AS start, CAST(length('Le fournisseur ') + length(s_name) AS INT) AS \"end\" FROM supplier")
def located_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentence = F.concat(F.lit("Le fournisseur "), "s_name", F.lit(" livre."))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.locate_span(sentence, F.concat(F.lit("« "), F.upper("s_name"), F.lit(" »"))).alias("x")).select("s_suppkey", "x.start", "x.end")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 8 < 6 THEN 5 END AS start, CASE WHEN p_partkey % 8 < 6 THEN CAST(5 + length('Le dépôt garde la pièce numéro  pour un an') + length(p_name) AS INT) END AS "end" FROM part""")
def reworded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as they are, without accents, with a word more, fewer, swapped or replaced are found; invented ones and those with three other words of eleven are not."""
    sentence = lambda a, b: F.concat(F.lit(a), "p_name", F.lit(b))
    said = sentence("Le dépôt garde la pièce numéro ", " pour un an")
    claims = [
        said, sentence("Le depot garde la piece numero ", " pour un an"), sentence("le dépôt garde donc la pièce numéro ", ", pour un an"), sentence("Le dépôt garde la pièce ", " pour un an"),
        sentence("Le dépôt garde pièce la numéro ", " pour un an"), sentence("le dépôt conserve la pièce numéro ", " pour un an"), F.lit("rien de tout cela ne figure ici"), sentence("Le dépôt vend une pièce ancienne ", " pour un an"),
    ]
    claim = F.coalesce(*[F.when(F.col("p_partkey") % 8 == k, c) for k, c in enumerate(claims)])
    whole = F.concat(F.lit("Oui, "), said, F.lit(". Mais rien de plus."))
    rows = table(spark, sf_dir, "part").select("p_partkey", whole.alias("text"), claim.alias("span"))
    return aligned.located(rows, ["p_partkey"]).select("p_partkey", "at.start", "at.end")


# --- relations


@query("""
WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT a.conv_id, a.turn AS l, b.turn AS r FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn - a.turn <= 6""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.col("turn").alias("seg_no")).distinct()
    return relate.candidate_pairs(turns, keys=("conv_id",))


@query("""
WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT a.conv_id, a.turn AS conclusion, b.turn AS premise FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn <> a.turn AND b.turn BETWEEN a.turn - 12 AND a.turn + 3""")
def support_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.col("turn").alias("seg_no")).distinct()
    return relate.support_candidates(turns, keys=("conv_id",))


@query(expected_sql("SELECT DISTINCT doc_id, CAST(unnest(conditions) AS INT) AS premise, CAST(conclusion AS INT) AS conclusion FROM docs JOIN rule_x USING (family)"))
def proven_grounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs(spark, sf_dir)["grounds"].select("doc_id", "premise", "conclusion")


@query(expected_sql("SELECT doc_id, CAST(rule_no AS INT) AS rule_no, CAST(conclusion AS INT) AS conclusion, CAST(variant_no AS INT) AS variant_no, array_to_string(conditions, ',') AS conditions FROM docs JOIN rule_x USING (family)"))
def rules_with_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs(spark, sf_dir)["rules"].select("doc_id", "rule_no", "conclusion", "variant_no", joined("conditions").alias("conditions"))


# --- rankings


@query(expected_sql("SELECT doc_id, CAST(seg.seg_no AS INT) AS seg_no, marker AS cue FROM seg JOIN mark_x ON seg.family = mark_x.family AND seg.seg_no = mark_x.seg_no").replace("marker AS cue", "replace(marker, 'é', 'e') AS cue"))
def ranking_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs(spark, sf_dir)["features"].where("ranking").select("doc_id", "seg_no", "cue")


@query(expected_sql("SELECT doc_id, CAST(pref_no AS INT) AS pref_no, CAST(winner AS INT) AS winner, CAST(loser AS INT) AS loser, array_to_string(whens, ',') AS whens FROM docs JOIN pref_x USING (family)"))
def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs(spark, sf_dir)["preferences"].select("doc_id", "pref_no", "winner", "loser", joined("when_contexts").alias("whens"))


@query(expected_sql("SELECT doc_id, CAST(winner_pref AS INT) AS winner_pref, CAST(loser_pref AS INT) AS loser_pref, array_to_string(whens, ',') AS whens FROM docs JOIN meta_x USING (family)"))
def meta_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs(spark, sf_dir)["meta_preferences"].select("doc_id", "winner_pref", "loser_pref", joined("when_contexts").alias("whens"))


@query(expected_sql("SELECT DISTINCT doc_id, CAST(least(winner, loser) AS INT) AS a, CAST(greatest(winner, loser) AS INT) AS b FROM docs JOIN pref_x USING (family)"))
def complement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs(spark, sf_dir)["complements"]


@query("""
WITH given AS (SELECT c_custkey AS doc_id, 0 AS row_no, [1, 2] AS preferred, [3, 4] AS contrasted, '7' AS whens FROM customer
               UNION ALL SELECT c_custkey, 1, [1 + c_custkey % 2, 2], [3, 1], CASE WHEN c_custkey % 3 = 0 THEN '8' ELSE '7' END FROM customer),
won AS (SELECT doc_id, row_no, contrasted, whens, unnest(preferred) AS winner, unnest([1, 2]) AS w FROM given),
both_sides AS (SELECT doc_id, row_no, whens, winner, w, unnest(contrasted) AS loser, unnest([1, 2]) AS l FROM won),
ranked AS (SELECT doc_id, whens, winner, loser, min(row_no * 100 + w * 10 + l) AS event FROM both_sides WHERE winner <> loser AND loser <> 4 GROUP BY ALL)
SELECT doc_id, CAST(row_no AS INT) AS row_no, CAST(winner AS INT) AS winner, CAST(loser AS INT) AS loser, whens, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY event) AS INT) AS pref_no
FROM both_sides JOIN ranked USING (doc_id, whens, winner, loser)""")
def option_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    k = F.col("doc_id").cast("int")
    arrays = lambda *xs: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    first = docs.select("doc_id", F.lit(0).alias("row_no"), arrays(1, 2).alias("preferred"), arrays(3, 4).alias("contrasted"), arrays(7).alias("when_contexts"))
    second = docs.select("doc_id", F.lit(1), arrays(1 + k % 2, 2), arrays(3, 1), arrays(F.when(k % 3 == 0, 8).otherwise(7)))
    one_rule = [F.struct(F.lit(n).alias("rule_no"), F.lit(c).alias("conclusion")) for n, c in ((1, 1), (2, 2), (3, 3), (4, 3))]
    rules = docs.select("doc_id", F.inline(F.array(*one_rule)))
    return graph.ranked_groups(first.unionAll(second), rules).select("doc_id", "row_no", "winner", "loser", joined("when_contexts").alias("whens"), "pref_no")


@query("""
WITH w AS (SELECT p_partkey, p_brand, length(p_name) AS long, unnest(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9_]+'), lambda x: length(x) > 1))) AS word FROM part),
n AS (SELECT p_partkey, count(*) AS n FROM w GROUP BY ALL),
c AS (SELECT m.p_brand AS doc_id, m.p_partkey AS mention_no, o.p_partkey AS seg_no, o.long, count(*) AS common FROM w m JOIN w o ON m.p_brand = o.p_brand AND m.word = o.word WHERE m.p_partkey % 2 = 0 AND o.p_partkey % 2 = 1 GROUP BY ALL)
SELECT doc_id, mention_no, seg_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, mention_no ORDER BY common DESC, long, seg_no) AS place FROM c JOIN n ON n.p_partkey = mention_no WHERE common >= 0.5 * n) WHERE place = 1""")
def mentioned_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), "p_partkey", "p_name")
    mentions = parts.where("p_partkey % 2 = 0").select("doc_id", F.col("p_partkey").alias("mention_no"), F.col("p_name").alias("mention"))
    return scope.mentioned_options(mentions, parts.where("p_partkey % 2 = 1").select("doc_id", F.col("p_partkey").alias("seg_no"), F.col("p_name").alias("seg_text")))


# --- annotation


@query(expected_sql('SELECT doc_id, ent_id, kind, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", span FROM ent'))
def brat_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs(spark, sf_dir)["entities"]


EVENTS = """,
own AS (SELECT doc_id, seg_no, ent_id FROM ent WHERE kind <> 'Marker'),
n_rules AS (SELECT family, count(*) AS n FROM rule_x GROUP BY family),
n_prefs AS (SELECT family, count(*) AS n FROM pref_x GROUP BY family),
rule_c AS (SELECT doc_id, rule_no, conclusion, unnest(conditions) AS premise FROM docs JOIN rule_x USING (family)),
rule_ev AS (SELECT r.doc_id, 'E' || rule_no AS ev_id, 'rule' AS kind, max(o.ent_id) AS trigger, string_agg('Condition:' || c.ent_id, ' ' ORDER BY premise) || ' Effect:' || max(o.ent_id) AS roles
            FROM rule_c r JOIN own c ON c.doc_id = r.doc_id AND c.seg_no = premise JOIN own o ON o.doc_id = r.doc_id AND o.seg_no = conclusion GROUP BY r.doc_id, rule_no),
mark AS (SELECT doc_id, ent_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS pref_no FROM ent WHERE kind = 'Marker'),
pref_ev AS (SELECT d.doc_id, 'E' || (n_rules.n + p.pref_no) AS ev_id, 'prefer' AS kind, mark.ent_id AS trigger,
            'Winner:E' || w.rule_no || ' Loser:E' || l.rule_no || ' When:' || c.ent_id AS roles
            FROM docs d JOIN pref_x p USING (family) JOIN n_rules USING (family) JOIN rule_x w ON w.family = d.family AND w.conclusion = p.winner JOIN rule_x l ON l.family = d.family AND l.conclusion = p.loser
            JOIN mark ON mark.doc_id = d.doc_id AND mark.pref_no = p.pref_no JOIN own c ON c.doc_id = d.doc_id AND c.seg_no = p.whens[1]),
meta_ev AS (SELECT d.doc_id, 'E' || (n_rules.n + n_prefs.n + 1) AS ev_id, 'meta_prefer' AS kind, mark.ent_id AS trigger,
            'Winner:E' || (n_rules.n + winner_pref) || ' Loser:E' || (n_rules.n + loser_pref) || ' When:' || c.ent_id AS roles
            FROM docs d JOIN meta_x m USING (family) JOIN n_rules USING (family) JOIN n_prefs USING (family)
            JOIN mark ON mark.doc_id = d.doc_id AND mark.pref_no = winner_pref JOIN own c ON c.doc_id = d.doc_id AND c.seg_no = m.whens[1]),
ev AS (SELECT * FROM rule_ev UNION ALL SELECT * FROM pref_ev UNION ALL SELECT * FROM meta_ev)
"""


@query(expected_sql(EVENTS + "SELECT doc_id, ev_id, kind, trigger, roles FROM ev"))
def brat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs(spark, sf_dir)["events"].select("doc_id", "ev_id", "kind", "trigger", roles_text().alias("roles"))


@query(expected_sql(EVENTS + """, line AS (
SELECT doc_id, 0 AS section, CAST(substr(ent_id, 2) AS INT) AS n, ent_id || chr(9) || kind || ' ' || start || ' ' || "end" || chr(9) || span AS line FROM ent
UNION ALL SELECT doc_id, 1, CAST(substr(ev_id, 2) AS INT), ev_id || chr(9) || kind || ':' || trigger || ' ' || roles FROM ev)
SELECT doc_id, string_agg(line, chr(10) ORDER BY section, n) AS ann FROM line GROUP BY doc_id"""))
def brat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs(spark, sf_dir)
    return brat.render(g["entities"], g["events"])


@query(expected_sql(EVENTS + "SELECT doc_id, ev_id AS id, kind, trigger || ' ' || roles AS content FROM ev UNION ALL SELECT doc_id, ent_id, kind, span FROM ent"))
def brat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, events, _ = brat.parse(brat_render(spark, sf_dir))
    return events.select("doc_id", F.col("ev_id").alias("id"), "kind", F.concat_ws(" ", "trigger", roles_text()).alias("content")).unionByName(entities.select("doc_id", F.col("ent_id").alias("id"), "kind", F.col("span").alias("content")))


@query(expected_sql("""
, said AS (
  SELECT doc_id, ent_id, 'Modality' AS name, CASE doc_id % 3 WHEN 0 THEN 'obligatory' WHEN 1 THEN 'permitted' ELSE 'recommended' END AS value FROM ent WHERE kind = 'Option' UNION ALL
  SELECT doc_id, ent_id, 'Negated', NULL FROM ent WHERE kind <> 'Marker' AND (doc_id + CAST(substr(ent_id, 2) AS INT)) % 4 = 0)
SELECT doc_id, 'A' || row_number() OVER (PARTITION BY doc_id ORDER BY CAST(substr(ent_id, 2) AS INT), name) AS attr_id, name, ent_id, value FROM said"""))
def brat_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes said of entities, some twice and some of none, as they are written and read again."""
    g = graphs(spark, sf_dir)
    ent = g["entities"]
    modality = F.element_at(F.array(F.lit("obligatory"), F.lit("permitted"), F.lit("recommended")), (F.col("doc_id") % 3 + 1).cast("int"))
    told = ent.where("kind = 'Option'").select("doc_id", "ent_id", F.lit("Modality").alias("name"), modality.alias("value"))
    negated = ent.where("kind <> 'Marker'").where((F.col("doc_id") + brat.number("ent_id")) % 4 == 0).select("doc_id", "ent_id", F.lit("Negated").alias("name"), F.lit(None).cast("string").alias("value"))
    said = told.unionByName(negated).unionByName(told).unionByName(told.withColumn("ent_id", F.lit("T900")))
    return brat.parse(brat.render(ent, g["events"], brat.attributes(ent, said)))[2]


@query()
def lpp_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs(spark, sf_dir)
    return brat.render_lpp(g["entities"], g["events"])


@query("""
SELECT c_custkey AS doc_id, code, subject FROM customer, (VALUES (1, 'duplicate_entity', 'T1'), (2, 'bad_rule_shape', 'E1'), (3, 'bad_line', 'hello'), (4, 'no_option', NULL)) AS v(fault, code, subject)
WHERE c_custkey % 5 = fault""")
def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = "T1\tOption 0 4\tabcd\nT2\tContext 5 9\tefgh\nE1\trule:T1 Condition:T2 Effect:T1"
    made = F.when(F.col("c_custkey") % 5 == 1, good + "\nT1\tOption 0 4\tabcd").when(F.col("c_custkey") % 5 == 2, good.replace(" Condition:T2", "")).when(F.col("c_custkey") % 5 == 3, good + "\nhello").when(F.col("c_custkey") % 5 == 4, "T2\tContext 5 9\tefgh").otherwise(good)
    return brat.violations(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), made.alias("ann")))


@query("SELECT p_partkey AS doc_id, 'T1' AS ent_id, CAST(4 AS INT) AS start, CAST(4 + length(p_name) AS INT) AS \"end\" FROM part")
def repaired_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Une "), "p_name", F.lit(".")).alias("text"), F.col("p_name").alias("span"))
    claims = parts.select("doc_id", F.lit("T1").alias("ent_id"), F.lit("Option").alias("kind"), F.lit(7).alias("start"), F.lit(9).alias("end"), "span")
    return brat.repair_offsets(claims, parts).select("doc_id", "ent_id", "start", "end")


# --- consequences


CONSEQUENCES = EVENTS + """,
ctx AS (SELECT doc_id, family, list(ent_id ORDER BY ent_id) AS contexts FROM ent WHERE kind = 'Context' GROUP BY ALL),
trial AS (SELECT doc_id, family, m AS trial_no, list_filter(contexts, lambda c, i: (m >> (i - 1)) & 1 = 1) AS active FROM (SELECT *, unnest(range(1 << len(contexts))) AS m FROM ctx)),
cond AS (SELECT r.doc_id, rule_no, max(o.ent_id) AS option, list(c.ent_id) AS need FROM rule_c r JOIN own c ON c.doc_id = r.doc_id AND c.seg_no = premise JOIN own o ON o.doc_id = r.doc_id AND o.seg_no = conclusion GROUP BY ALL),
appl AS (SELECT t.doc_id, t.family, trial_no, active, rule_no, option FROM trial t JOIN cond ON cond.doc_id = t.doc_id WHERE list_has_all(active, need)),
beaten AS (SELECT DISTINCT w.doc_id, w.trial_no, l.rule_no FROM appl w JOIN appl l ON w.doc_id = l.doc_id AND w.trial_no = l.trial_no JOIN pref_x p ON p.family = w.family
           JOIN rule_x rw ON rw.family = p.family AND rw.conclusion = p.winner AND rw.rule_no = w.rule_no JOIN rule_x rl ON rl.family = p.family AND rl.conclusion = p.loser AND rl.rule_no = l.rule_no
           JOIN own c ON c.doc_id = w.doc_id AND c.seg_no = p.whens[1] WHERE list_contains(w.active, c.ent_id)),
stands AS (SELECT DISTINCT a.doc_id, a.trial_no, option FROM appl a ANTI JOIN beaten b ON a.doc_id = b.doc_id AND a.trial_no = b.trial_no AND a.rule_no = b.rule_no)
SELECT t.doc_id, CAST(t.trial_no AS INT) AS trial_no, coalesce(string_agg(option, ',' ORDER BY option), '') AS concluded FROM trial t LEFT JOIN stands s ON s.doc_id = t.doc_id AND s.trial_no = t.trial_no GROUP BY ALL
"""


@query(expected_sql(CONSEQUENCES))
def consequences_all_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs(spark, sf_dir)
    programs = evaluate.programs(g["entities"], g["events"])
    return evaluate.conclusions(programs, evaluate.trials(programs)).select("doc_id", "trial_no", joined("concluded").alias("concluded"))


TRIED, CONCLUDED = CONSEQUENCES[: CONSEQUENCES.index("SELECT t.doc_id, CAST")], CONSEQUENCES[CONSEQUENCES.index("SELECT t.doc_id, CAST") :]
NEUTRALISED = """WHERE list_contains(w.active, c.ent_id) AND NOT EXISTS (
  SELECT 1 FROM meta_x m JOIN own mc ON mc.seg_no = m.whens[1] WHERE m.family = p.family AND m.loser_pref = p.pref_no AND mc.doc_id = w.doc_id AND list_contains(w.active, mc.ent_id))"""


@query(expected_sql(TRIED.replace("WHERE list_contains(w.active, c.ent_id)", NEUTRALISED) + CONCLUDED))
def neutralised_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consequences where a preference that an active one between preferences beats defeats nothing."""
    g = graphs(spark, sf_dir)
    programs = evaluate.programs(g["entities"], g["events"])
    return evaluate.conclusions(programs, evaluate.trials(programs), meta_effective=True, all_whens=True).select("doc_id", "trial_no", joined("concluded").alias("concluded"))


@query(expected_sql(TRIED + """, want AS (SELECT doc_id, trial_no, count(DISTINCT option) AS n FROM stands GROUP BY ALL),
got AS (SELECT doc_id, trial_no, count(DISTINCT option) AS n FROM appl GROUP BY ALL),
told AS (
  SELECT t.doc_id, count(*) AS trials, CAST(count_if(coalesce(w.n, 0) = coalesce(g.n, 0)) AS BIGINT) AS agreements, CAST(sum(coalesce(w.n, 0)) AS BIGINT) AS expected, CAST(sum(coalesce(g.n, 0)) AS BIGINT) AS given
  FROM trial t LEFT JOIN want w ON w.doc_id = t.doc_id AND w.trial_no = t.trial_no LEFT JOIN got g ON g.doc_id = t.doc_id AND g.trial_no = t.trial_no GROUP BY t.doc_id)
SELECT *, expected AS common, expected::DOUBLE / given AS precision, 1.0::DOUBLE AS recall, 2 * (expected::DOUBLE / given) / (expected::DOUBLE / given + 1) AS f1 FROM told"""))
def weakened_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs against themselves without preferences: what is defeated in the one is concluded in the other."""
    g = graphs(spark, sf_dir)
    whole, rules = evaluate.programs(g["entities"], g["events"]), evaluate.programs(g["entities"], g["events"].where("kind = 'rule'"))
    return evaluate.compare(whole, rules)


@query()
def uniform_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs(spark, sf_dir)
    programs = evaluate.programs(g["entities"], g["events"])
    return evaluate.compare(programs, programs, meta_effective=True, all_whens=True)


# --- scores


@query("""
SELECT CAST(l_orderkey AS BIGINT) AS doc_id, kind, CAST(sum(CASE WHEN shift < 5 THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS given, count(*) AS expected
FROM (SELECT l_orderkey, CASE l_linenumber % 2 WHEN 0 THEN 'Context' ELSE 'Option' END AS kind, CAST(l_quantity AS INT) % 10 AS shift FROM lineitem) GROUP BY ALL""")
def entity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("T"), F.row_number().over(_by_order()).cast("string")).alias("ent_id"), F.when(F.col("l_linenumber") % 2 == 0, "Context").otherwise("Option").alias("kind"), (F.row_number().over(_by_order()) * 100).alias("start"), (F.col("l_quantity").cast("int") % 10).alias("shift"))
    reference = base.select("doc_id", "ent_id", "kind", "start", (F.col("start") + 15).alias("end"))
    produced = base.select("doc_id", "ent_id", "kind", (F.col("start") + F.col("shift") + 0).alias("start"), (F.col("start") + F.col("shift") + F.when(F.col("shift") < 5, 15).otherwise(60)).alias("end"))
    counts = score.entity_counts(produced, reference, score.alignment(produced, reference))
    return counts.select("doc_id", "kind", F.col("correct").cast("long"), F.col("given").cast("long"), F.col("expected").cast("long"))


def _by_order() -> WindowSpec:
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(expected_sql("""SELECT kind, CAST(sum(n) AS BIGINT) AS correct, CAST(sum(n) AS BIGINT) AS given, CAST(sum(n) AS BIGINT) AS expected, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM (
SELECT kind, count(*) AS n FROM ent GROUP BY kind UNION ALL SELECT 'rule', count(*) FROM docs JOIN rule_x USING (family) UNION ALL SELECT 'prefer', count(*) FROM docs JOIN pref_x USING (family)
UNION ALL SELECT 'meta_prefer', count(*) FROM docs JOIN meta_x USING (family) UNION ALL SELECT 'unanchored', count(*) FROM docs JOIN (SELECT family FROM pref_x UNION ALL SELECT family FROM meta_x) USING (family)) GROUP BY kind"""))
def score_against_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs(spark, sf_dir)
    both = g["entities"], g["events"]
    return score.ratios(score.score(both, both), "kind")


@query(expected_sql("SELECT count(*) AS documents, CAST(count_if(family IN (2, 3)) AS BIGINT) AS polluted, CAST(2 * count_if(family = 2) + count_if(family = 3) AS BIGINT) AS invented FROM docs WHERE family IN (2, 3)"))
def pollution_of_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs(spark, sf_dir)
    return score.pollution(g["docs"].where("doc_id % 5 IN (2, 3)"), g["entities"], g["events"])


REPORT = """
WITH doc AS (SELECT docs.doc_id, family, c_mktsegment AS corpus FROM docs JOIN customer ON c_custkey = docs.doc_id),
own AS (
  SELECT doc_id, kind, CAST(count_if(NOT (kind = 'Marker' AND doc_id % 3 = 0)) AS BIGINT) AS correct, count(*) AS expected FROM ent GROUP BY doc_id, kind),
each AS (
  SELECT doc_id, kind, correct, correct + CASE WHEN kind = 'Context' AND doc_id % 4 = 0 THEN 1 ELSE 0 END AS given, expected FROM own UNION ALL
  SELECT doc_id, 'rule', n, n, n FROM doc JOIN (SELECT family, count(*) AS n FROM rule_x GROUP BY family) USING (family) UNION ALL
  SELECT doc_id, kind, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE n END, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE n END, n
  FROM doc JOIN (SELECT family, 'prefer' AS kind, count(*) AS n FROM pref_x GROUP BY family UNION ALL SELECT family, 'meta_prefer', count(*) FROM meta_x GROUP BY family
                 UNION ALL SELECT family, 'unanchored', count(*) FROM (SELECT family FROM pref_x UNION ALL SELECT family FROM meta_x) GROUP BY family) USING (family)),
told AS (
  SELECT corpus, each.* FROM each JOIN doc USING (doc_id) UNION ALL
  SELECT corpus, doc_id, CASE WHEN kind IN ('Context', 'Option', 'Marker') THEN 'entities' ELSE 'priorities' END, correct, given, expected FROM each JOIN doc USING (doc_id) WHERE kind NOT IN ('rule', 'unanchored')),
summed AS (
  SELECT corpus, doc_id, kind, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(given) AS BIGINT) AS given, CAST(sum(expected) AS BIGINT) AS expected
  FROM told GROUP BY GROUPING SETS ((corpus, doc_id, kind), (corpus, kind), (kind))),
ratio AS (
  SELECT *, CASE WHEN given > 0 THEN correct::DOUBLE / given WHEN expected = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS precision,
         CASE WHEN expected > 0 THEN correct::DOUBLE / expected ELSE 1.0::DOUBLE END AS recall FROM summed)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM ratio"""


def _spoiled(g: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Entities and events with markers and rankings missing and a context of one letter invented."""
    invented = g["docs"].where("doc_id % 4 = 0").select("doc_id", F.lit("T99").alias("ent_id"), F.lit("Context").alias("kind"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.left("text", F.lit(1)).alias("span"))
    return g["entities"].where("NOT (kind = 'Marker' AND doc_id % 3 = 0)").unionByName(invented), g["events"].where("kind = 'rule' OR doc_id % 2 = 1")


@query(expected_sql("SELECT * FROM (" + REPORT.strip() + ")"))
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spoiled graph against what it was made from: every document, every market segment as a corpus, and all."""
    g = graphs(spark, sf_dir)
    counts = score.score(_spoiled(g), (g["entities"], g["events"]))
    return score.report(counts, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("corpus")))


@query(expected_sql("""SELECT doc_id, ent_id, 'missed' AS fault, 'absent' AS cause FROM ent WHERE kind = 'Marker' AND doc_id % 3 = 0 UNION ALL
SELECT doc_id, 'T99', 'invented', CASE (SELECT kind FROM ent e WHERE e.doc_id = docs.doc_id AND e.start = 0) WHEN 'Context' THEN 'boundary' ELSE 'kind' END FROM docs WHERE doc_id % 4 = 0"""))
def causes_of_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs(spark, sf_dir)
    produced = _spoiled(g)[0]
    return score.causes_of_entities(produced, g["entities"], score.alignment(produced, g["entities"]))


# --- votes, corpora


@query("""
WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS ballots, max(n) AS best FROM v GROUP BY user_id)
SELECT t.user_id, coalesce(max(CASE WHEN v.n * 2 > ballots THEN event_type END), 'none') AS event_type FROM t JOIN v ON v.user_id = t.user_id GROUP BY t.user_id""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type", "none")


@query("""
WITH b AS (SELECT user_id, count(*) AS ballots FROM events GROUP BY user_id),
w AS (SELECT user_id, tag, count(*) AS n FROM (SELECT user_id, event_type AS tag FROM events UNION ALL SELECT user_id, 'high' FROM events WHERE value > 50) GROUP BY ALL)
SELECT b.user_id, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (n * 2 > ballots), 'N') AS tags FROM b LEFT JOIN w ON w.user_id = b.user_id GROUP BY b.user_id""")
def majority_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ballots = table(spark, sf_dir, "events").select("user_id", F.when(F.col("value") > 50, F.array("event_type", F.lit("high"))).otherwise(F.array("event_type")).alias("tags"))
    return vote.majority_tags(ballots, ["user_id"]).select("user_id", joined("tags").alias("tags"))


@query("SELECT o_custkey, o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 4) AS INT) AS batch_no FROM orders")
def batched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.batches(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), 4, ["o_custkey"], "o_orderkey")


@query("""
SELECT doc_id, sha256(coalesce(text, '')) AS source_sha256, CASE WHEN doc_id % 7 <> 0 THEN sha256(CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(text, '') END) END AS output_sha256,
       CASE WHEN doc_id % 7 <> 0 THEN 'ok' ELSE 'error' END AS status, doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR coalesce(text, '') = '') AS is_empty FROM documents""")
def batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    output = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.coalesce("text", F.lit("")))
    return corpora.manifest(docs, docs.where("doc_id % 7 <> 0").select("doc_id", output.alias("output")))


@query("""
WITH n AS (SELECT user_id, count(*) AS calls FROM events WHERE event_type = 'click' GROUP BY user_id),
m AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'ok' ELSE 'error' END AS status, doc_id % 7 <> 0 AND coalesce(text, '') = '' AS is_empty, coalesce(calls, 0) AS llm_calls FROM documents LEFT JOIN n ON user_id = doc_id)
SELECT *, count(*) OVER () AS total, CAST(count_if(status = 'ok') OVER () AS BIGINT) AS succeeded, CAST(count_if(is_empty) OVER () AS BIGINT) AS empty, CAST(sum(llm_calls) OVER () AS BIGINT) AS all_calls, true AS timed FROM m""")
def recorded_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a run as it was written and read again, with its summary."""
    docs, replies = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("doc_id"))
    rows = corpora.manifest(docs, docs.where("doc_id % 7 <> 0").select("doc_id", F.coalesce("text", F.lit("")).alias("output")), replies)
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    corpora.recorded(spark, rows, path, source=f"{sf_dir}/documents.parquet", stage="hybrid", votes=3)
    written = spark.read.schema("doc_id long, status string, is_empty boolean, llm_calls long").json(f"{path}/documents")
    told = F.from_json("value", "summary struct<total: long, succeeded: long, empty: long, llm_calls: long, duration_s: double>")["summary"]
    summary = spark.read.text(f"{path}/summary").select(told.alias("s")).select("s.total", "s.succeeded", "s.empty", F.col("s.llm_calls").alias("all_calls"), (F.col("s.duration_s") > 0).alias("timed"))
    return written.join(F.broadcast(summary))  # one row


BALLOT_SQL = """
WITH line AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n, l_returnflag AS v FROM lineitem)
"""


@query(BALLOT_SQL + "SELECT k, CAST(3 * r AS INT) AS item, v AS value FROM line WHERE NOT (k % 5 IN (2, 3) AND r = 1) UNION ALL SELECT k, 3, 'x' FROM line WHERE k % 5 = 3 AND n = 1")
def repaired_ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ballots as asked, counted from 1, with the first answer left out (in two ballots, one of which has the last left out too), and counted from 101; the fullest are kept."""
    n = F.row_number().over(_by_order())
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("r"), F.col("l_returnflag").alias("value"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))
    asked, way = (3 * F.col("r")).cast("int"), F.col("k") % 5
    given = F.when(way == 1, F.col("r")).when(way == 4, F.col("r") + 100).otherwise(asked).cast("int")
    first = lines.where(~(way.isin(2, 3) & (F.col("r") == 1))).select("k", F.lit(2).alias("ballot_no"), given.alias("item"), "value")
    # a number that was not asked for (alone, it stands for the only line), and a ballot that stops short
    stray = lines.where((way == 3) & (F.col("r") == 1)).select("k", F.lit(2).alias("ballot_no"), F.lit(7).alias("item"), F.lit("x").alias("value"))
    short = lines.where((way == 2) & (F.col("r") > 1) & (F.col("r") < F.col("n"))).select("k", F.lit(1).alias("ballot_no"), asked.alias("item"), F.lit("y").alias("value"))
    expected = lines.select("k", asked.alias("item"))
    whole = vote.repaired(first.unionByName(stray).unionByName(short), expected, ["k"])
    return vote.fullest(whole, expected, ["k"]).select("k", "item", "value")


@query("SELECT count(*) AS total, CAST(count_if(doc_id % 7 <> 0) AS BIGINT) AS succeeded, CAST(count_if(doc_id % 7 = 0) AS BIGINT) AS failed, CAST(count_if(doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR coalesce(text, '') = '')) AS BIGINT) AS empty FROM documents")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.summary(batch_manifest(spark, sf_dir))


@query("SELECT c_custkey, 'in/' || c_name || '.ann' AS ann, 'in/' || c_name || '.lpp' AS lpp FROM customer")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("in/"), "c_name", F.lit(".txt"))
    return table(spark, sf_dir, "customer").select("c_custkey", corpora.output_path(path).alias("ann"), corpora.output_path(path, "lpp").alias("lpp"))


@query(r"""
WITH body AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS body FROM pages),
p AS (SELECT page_id, unnest(list_zip(found, range(len(found)))) AS x FROM (SELECT page_id, regexp_extract_all(body, '(?is)<p\b[^>]*>(.*?)</p\s*>', 1) AS found FROM body)),
bare AS (SELECT page_id, x[2] AS pos, regexp_replace(x[1], '(?s)<[^>]*>', '', 'g') AS t FROM p),
read AS (
  SELECT page_id, pos, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM bare),
plain AS (SELECT page_id, pos, trim(regexp_replace(t, '[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS paragraph FROM read),
one AS (SELECT page_id, paragraph, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS par_no FROM plain GROUP BY page_id, paragraph)
SELECT page_id, CAST(par_no AS INT) AS par_no, paragraph FROM one WHERE length(paragraph) BETWEEN 20 AND 100000 AND paragraph LIKE '%.' AND paragraph NOT LIKE '%;.'""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.paragraphs(table(spark, sf_dir, "pages"), shortest=20, longest=100_000)


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_àâäéèêëîïôöùûüçñóíáúßæœ])(ou|soit|either|or|choix|options?|alternatives?)($|[^a-z0-9_àâäéèêëîïôöùûüçñóíáúßæœ])') AS open FROM documents WHERE text IS NOT NULL")
def enumeration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.has("text", cues.ALTERNATIVE_GATE).alias("open"))
