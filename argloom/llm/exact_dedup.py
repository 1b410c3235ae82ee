"""Exact dedup by Golomb-coded fingerprint exchange.

Texts are equal when identical after each run of ASCII blanks becomes one space. Each
partition sends the sorted, compressed 64-bit fingerprints of its texts to their
owners and gets back bitmaps of those that occur again. Only rows of recurring
fingerprints (suspects) have their texts compared, by grouping on the whole text:
texts are combined within each task before they move, so a group that holds a third
of all rows moves once a task. The smallest id of a group stays.

Defined cases: a null text counts as empty, and empty texts are equal to each other;
a null id ranks after all others; of repeated rows with one id and text exactly one
stays; other columns are not looked at. An empty table gives an empty result. The plan
of docs must give the same rows in the same partitions when it runs again (as a table
that is read does): ``dedup`` finds rows by number, and another text there is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argloom.llm import exchange
from argloom.llm.util import attach, by_row, cut, ship, tasks

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def recurring(fingerprints: DataFrame, owners: int) -> DataFrame:
    """fp of every fingerprint that two rows of fingerprints (block, fp) share."""
    ship(fingerprints.sparkSession)

    def send(rows: pa.Table) -> pa.Table:
        values, counts = np.unique(rows.column("fp").to_numpy().view(np.uint64), return_counts=True)
        return exchange.table(exchange.messages(0, rows.column("block")[0].as_py(), owners, values, counts > 1))

    def receive(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        values = np.unique(rows.column("fp").to_numpy().view(np.uint64))
        return pa.table({"fp": values[exchange.flags_of(bitmaps, 0, values, owners)].view(np.int64)})

    blocks = fingerprints.select("block", "fp")
    bitmaps = exchange.answers(blocks.groupBy("block").applyInArrow(send, exchange.MESSAGE))
    return blocks.groupBy("block").cogroup(bitmaps.groupBy("block")).applyInArrow(receive, "fp long").distinct()


def _rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Per row: id, row, sha; and per group of two rows or more: sha, keep_id, keep_row, group_size."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"), normalised(F.col(text)).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    rows = cut(texts.select("id", "row", "fp", F.sha2("norm", 256).alias("sha"), F.spark_partition_id().cast("long").alias("block")))
    suspects = recurring(rows, tasks(spark))
    # byte verification: groups are by the text itself; a digest that two texts share would be an error, not a merge
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    verified = (
        texts.join(suspects, "fp", "left_semi").groupBy("norm").agg(F.min(first).alias("keep"), F.count("*").alias("n"))
        .groupBy(F.sha2("norm", 256).alias("sha")).agg(F.min("keep").alias("keep"), F.sum("n").alias("group_size"), F.count("*").alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.col("group_size")))
        .select("sha", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size")
    )
    return rows, cut(verified)


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    alone = F.col("group_size").isNull()
    return attach(*_rows(docs, text, doc_id), "sha", "group_size").select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    alone = F.col("group_size").isNull()
    kept = attach(*_rows(docs), "sha", "group_size").where(alone | (F.col("row") == F.col("keep_row"))).select("row", "sha")
    return by_row(docs, kept, normalised(F.col("__row.text")))
