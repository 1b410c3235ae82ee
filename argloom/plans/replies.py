"""Registered queries of verification by replies, over line items as propositions, and their SQL.

An order is a document, its lines are propositions, numbered anew; the first four are its first paragraph.
Columns decide what is proven, which lines are siblings or alternatives, and what a model
replies: questions are asked, answered from the columns and read back stage by stage. The
SQL works out what must stand without any question.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argloom.operators import verify
from argloom.session import beside, dealt


def _kept(df: DataFrame) -> DataFrame:
    return dealt(df, "doc_id")


def _settings(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Features, proofs and siblings of the lines, which are shuffled here and never again."""
    # lines that are alike up to the quantity are alike in all that is taken from them, so the price need not part them
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    last, quantity = F.lead(F.lit(False), 1, True).over(w), F.col("l_quantity").cast("long")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("seg_no"), F.lit(0).alias("speaker"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        (quantity % 10 != 3).alias("can_conclude"), (quantity % 10 != 7).alias("can_condition"), F.coalesce(F.lag("l_suppkey").over(w) % 11 == 0, F.lit(False)).alias("alternative"), last.alias("last"),
    )
    features = _kept(lines.withColumn("paragraph", F.when(F.col("seg_no") > 4, 1).otherwise(0)))
    pairs = features.where("NOT last").withColumn("other", (F.col("seg_no") + 1).cast("int"))
    ahead = F.col("p") % 2 == 0
    proven = pairs.where("p % 5 = 0 AND seg_no <> 4").select("doc_id", F.when(ahead, F.col("seg_no")).otherwise(F.col("other")).alias("premise"), F.when(ahead, F.col("other")).otherwise(F.col("seg_no")).alias("conclusion"))
    siblings = pairs.where("s % 7 = 0").select("doc_id", F.col("seg_no").alias("l"), F.col("other").alias("r"))
    return {"features": features, "proven": proven, "siblings": siblings}


def _ballots(said: DataFrame, stage: str, entries: Column) -> DataFrame:
    """Two ballots alike, the first with thoughts around, and one that can't be read."""
    payload = F.to_json(F.struct(entries.alias(stage)))
    three = F.array(F.concat(F.lit("<think>{}</think>```json\n"), payload, F.lit("\n```")), payload, F.lit("no reply"))
    return said.groupBy("doc_id", "batch_no").agg(three.alias("p")).select("doc_id", F.lit(stage).alias("stage"), "batch_no", F.posexplode("p").alias("ballot_no", "payload"))


def _answer(asked: DataFrame, features: DataFrame, stage: str) -> DataFrame:
    """Replies to the questions of a stage."""
    of = lambda n, *columns: features.select("doc_id", F.col("seg_no").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in columns])
    if stage == "support":
        offered = asked.select("doc_id", "batch_no", F.explode("candidates").alias("g")).transform(beside, of("g", "p"), ["doc_id", "g"]).groupBy("doc_id", "batch_no").agg(F.collect_list(F.struct("g", "g_p")).alias("offered"))
        each = beside(asked.select("doc_id", "batch_no", F.explode("examined").alias("c")), of("c", "p"), ["doc_id", "c"]).transform(beside, offered, ["doc_id", "batch_no"])
        named = each.withColumn("g", F.transform(F.filter("offered", lambda x: (F.col("c_p") + x["g_p"]) % 3 == 0), lambda x: x["g"]))
        return _ballots(named.where("size(g) > 0"), stage, F.collect_list(F.struct("c", "g")))
    rows = beside(beside(asked, of("l", "p", "s"), ["doc_id", "l"]), of("r", "p", "s"), ["doc_id", "r"])
    if stage == "relations":
        said = rows.withColumn("v", F.get(F.array(F.lit("A_TO_B"), F.lit("b_to_a"), F.lit("NONE")), ((F.col("l_p") + F.col("r_p")) % 4).cast("int")))
    else:
        said = rows.withColumn("v", F.get(F.array(F.lit("no"), F.lit("Y"), F.lit("N")), ((F.col("l_s") + F.col("r_s")) % 4).cast("int")))
    return _ballots(said.where("v IS NOT NULL"), stage, F.collect_list(F.struct(F.col("item").alias("n"), F.col("v").alias("r"))))


def _dialogue(given: dict[str, DataFrame], strategy: str) -> Iterator[tuple[str, DataFrame]]:
    """What a strategy asks, each stage answered once before the next, and the grounds in the end."""
    lines = given["features"]
    going = verify.steps(lines, lines.select("doc_id", "seg_no"), given["proven"], strategy, siblings=given["siblings"], able=lines, keep=_kept)
    stage, found = next(going)
    while stage != "grounds":
        yield stage, found
        stage, found = going.send(_answer(found, lines, stage))
    yield stage, found


def _grounds(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    return dict(_dialogue(_settings(spark, sf_dir), strategy))["grounds"]


def grounds_of_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounds(spark, sf_dir, "hybrid")


def grounds_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounds(spark, sf_dir, "pairs")


def grounds_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounds(spark, sf_dir, "group")


def question_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each strategy asks of all documents; its last answers are not needed."""
    given, last = _settings(spark, sf_dir), {"group": "support", "pairs": "narrative", "hybrid": "narrative"}
    rows = []
    for strategy in verify.STRATEGIES:
        asked = {}
        for stage, questions in _dialogue(given, strategy):
            asked[stage] = questions
            if stage == last[strategy]:
                break
        rows.append(verify.costs(asked).groupBy("stage").agg(F.sum("questions").alias("questions"), F.sum("items").alias("items")).withColumn("strategy", F.lit(strategy)))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES = {f.__name__: f for f in (grounds_of_proposals, grounds_of_pairs, grounds_of_groups, question_costs)}

BASE = """
WITH line AS (
  SELECT *, CASE WHEN n > 4 THEN 1 ELSE 0 END AS para FROM (
    SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS n,
           l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) % 10 <> 3 AS concludes, CAST(l_quantity AS BIGINT) % 10 <> 7 AS conditions FROM lineitem)),
two AS (SELECT a.doc_id, a.n AS l, b.n AS r, a.para = b.para AS near, a.p AS lp, b.p AS rp, a.s AS ls, b.s AS rs FROM line a JOIN line b ON a.doc_id = b.doc_id AND a.n < b.n),
barred AS (SELECT doc_id, l, r FROM two WHERE r = l + 1 AND (ls % 7 = 0 OR ls % 11 = 0)),
proof AS (
  SELECT doc_id, l, r, CASE WHEN lp % 2 = 0 THEN l ELSE r END AS premise, CASE WHEN lp % 2 = 0 THEN r ELSE l END AS conclusion
  FROM two WHERE r = l + 1 AND near AND lp % 5 = 0 AND NOT (ls % 7 = 0 OR ls % 11 = 0)),
sound AS (
  SELECT proof.* FROM proof JOIN line c ON c.doc_id = proof.doc_id AND c.n = conclusion JOIN line q ON q.doc_id = proof.doc_id AND q.n = premise WHERE c.concludes AND q.conditions),
asked_hybrid AS (
  SELECT doc_id, n, para, p, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1) // 4 AS batch FROM line
  WHERE concludes AND NOT EXISTS (SELECT 1 FROM sound WHERE sound.doc_id = line.doc_id AND (sound.premise = line.n OR sound.conclusion = line.n))),
asked_group AS (SELECT doc_id, n, para, p, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1) // 4 AS batch FROM line),
"""


def _named(asked: str) -> str:
    """Support named in reply to the questions of a table."""
    return f"""
offer_{asked} AS (
  SELECT DISTINCT q.doc_id, q.batch, g.n AS g, g.p AS gp FROM asked_{asked} q JOIN line g ON g.doc_id = q.doc_id AND (g.n = q.n OR g.para = q.para AND g.n BETWEEN q.n - 12 AND q.n + 3)),
named_{asked} AS (SELECT q.doc_id, q.n AS conclusion, o.g AS premise FROM asked_{asked} q JOIN offer_{asked} o ON o.doc_id = q.doc_id AND o.batch = q.batch WHERE o.g <> q.n AND (q.p + o.gp) % 3 = 0)"""


PAIRS_OF = {
    "hybrid": """SELECT t.* FROM two t WHERE near AND EXISTS (SELECT 1 FROM named_hybrid x WHERE x.doc_id = t.doc_id AND least(x.conclusion, x.premise) = t.l AND greatest(x.conclusion, x.premise) = t.r)
  UNION SELECT t.* FROM two t JOIN proof USING (doc_id, l, r)""",
    "pairs": "SELECT * FROM two WHERE near AND r - l <= 6",
}


def _judged(strategy: str) -> str:
    return f"""
pair AS (SELECT * FROM ({PAIRS_OF[strategy]}) ANTI JOIN barred USING (doc_id, l, r)),
way AS (
  SELECT doc_id, l, r, premise, conclusion, true AS proven FROM pair JOIN proof USING (doc_id, l, r) UNION ALL
  SELECT doc_id, l, r, CASE (lp + rp) % 4 WHEN 0 THEN l ELSE r END, CASE (lp + rp) % 4 WHEN 0 THEN r ELSE l END, false FROM pair ANTI JOIN proof USING (doc_id, l, r) WHERE (lp + rp) % 4 < 2)"""


GUARDS = """,
fair AS (
  SELECT way.* FROM way JOIN two t USING (doc_id, l, r) JOIN line c ON c.doc_id = way.doc_id AND c.n = conclusion JOIN line q ON q.doc_id = way.doc_id AND q.n = premise
  WHERE c.concludes AND q.conditions AND (proven OR (t.ls + t.rs) % 4 IN (0, 2))),
clean AS (SELECT * FROM fair f WHERE proven OR NOT EXISTS (SELECT 1 FROM fair g WHERE g.doc_id = f.doc_id AND g.conclusion = f.conclusion AND g.proven)),
sib AS (SELECT doc_id, l, r FROM two WHERE r = l + 1 AND ls % 7 = 0 AND ls % 11 <> 0),
grown AS (
  SELECT doc_id, conclusion, premise FROM clean UNION SELECT doc_id, conclusion, sib.r FROM clean JOIN sib USING (doc_id) WHERE proven AND premise = sib.l
  UNION SELECT doc_id, conclusion, sib.l FROM clean JOIN sib USING (doc_id) WHERE proven AND premise = sib.r)"""


def _one_way(table: str) -> str:
    back = f"SELECT 1 FROM {table} b WHERE b.doc_id = a.doc_id AND b.conclusion = a.premise AND b.premise = a.conclusion"
    return f"SELECT doc_id, conclusion, premise FROM {table} a WHERE premise <> conclusion AND (premise < conclusion OR NOT EXISTS ({back}))"


def _costs(strategy: str) -> str:
    """Questions and items of the stages of a strategy."""
    lots = lambda table, stage: f"SELECT '{stage}' AS stage, CAST(sum(ceil(n / 10.0)) AS BIGINT) AS questions, CAST(sum(n) AS BIGINT) AS items, '{strategy}' AS strategy FROM (SELECT doc_id, count(*) AS n FROM {table} GROUP BY doc_id)"
    support = f"SELECT 'support' AS stage, CAST(count(DISTINCT (doc_id, batch)) AS BIGINT) AS questions, count(*) AS items, '{strategy}' AS strategy FROM asked_{strategy}"
    judged = f"{lots('(SELECT * FROM pair ANTI JOIN proof USING (doc_id, l, r))', 'relations')} UNION ALL {lots('(SELECT * FROM way WHERE NOT proven)', 'narrative')}"
    return {"group": support, "pairs": judged, "hybrid": f"{support} UNION ALL {judged}"}[strategy]


ORACLE_SQL = {
    "grounds_of_proposals": BASE.strip() + _named("hybrid") + "," + _judged("hybrid") + GUARDS + "\n" + _one_way("grown"),
    "grounds_of_pairs": BASE.strip() + _judged("pairs") + GUARDS + "\n" + _one_way("grown"),
    "grounds_of_groups": BASE.strip() + _named("group") + "\n" + _one_way("named_group"),
    "question_costs": f"""SELECT * FROM ({BASE.strip().rstrip(",")} {_costs("group")}) UNION ALL SELECT * FROM ({BASE.strip()}{_judged("pairs")} {_costs("pairs")})
UNION ALL SELECT * FROM ({BASE.strip()}{_named("hybrid")},{_judged("hybrid")} {_costs("hybrid")})""",
}
