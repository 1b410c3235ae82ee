"""What must hold of plans whatever the size: tables that grow with the input are not broadcast, and no work is done twice."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from argloom.functions import aligned
from argloom.operators import verify
from argloom.plans import replies
from argloom.session import cut


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_reworded_spans_broadcast_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "Oui, le dépôt garde la pièce numéro sept pour un an.", "le dépôt conserve la pièce numéro sept pour un an")], "k int, text string, span string").write.parquet(f"{tmp_path}/t")
    found = aligned.located(spark.read.parquet(f"{tmp_path}/t"), ["k"])
    assert "Broadcast" not in plan(found)
    assert tuple(found.select("at.start", "at.end").first()) == (5, 51)


def test_joins_of_cut_tables_broadcast_nothing(spark, tmp_path):
    spark.range(10).selectExpr("id AS doc_id", "array(1, 2, 3) AS n").write.parquet(f"{tmp_path}/t")
    rows = cut(spark.read.parquet(f"{tmp_path}/t").select("doc_id", F.explode("n").alias("n")))
    both = rows.join(rows.select("doc_id", (F.col("n") + 1).alias("n")).distinct(), ["doc_id", "n"])
    assert "Broadcast" not in plan(both) and both.count() == 20


def test_each_stage_is_worked_out_once(spark, monkeypatch):
    calls, of = [], verify.support_questions
    monkeypatch.setattr(verify, "support_questions", lambda *a, **b: calls.append(1) or of(*a, **b))
    assert replies.grounds_of_groups(spark, "/root/testdata/sf0.001").count() == 2430
    assert len(calls) == 1


def lines(spark, path) -> str:
    rows = spark.range(14).selectExpr("id DIV 7 AS l_orderkey", "5 * id AS l_partkey", "id AS l_suppkey", "CAST(id % 7 AS INT) AS l_linenumber", "CAST(id AS DOUBLE) AS l_quantity")
    rows.write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_grounds_of_pairs_shuffle_nothing_after_the_lines(spark, tmp_path):
    assert "Exchange" not in plan(replies.grounds_of_pairs(spark, lines(spark, tmp_path)))


def test_grounds_of_groups_shuffle_nothing_after_the_lines(spark, tmp_path):
    assert "Exchange" not in plan(replies.grounds_of_groups(spark, lines(spark, tmp_path)))
