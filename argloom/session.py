"""What operators need from the session: the shared folder, lineage cuts, and tables that stay where they were dealt to."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only where the session names none and all run on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "argloom-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: used by many plans, and safe from lost executors.

    Spark goes on taking it for as large as its plan was estimated, where rows that were
    exploded count once. So joins with it are to be merged: a broadcast would bring it
    whole to the driver.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint().hint("merge")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df, computed once and kept in the shared folder like ``cut``, but column by column and in buckets of a key: groups, windows and ``beside`` over this key (and more) don't shuffle it again."""
    spark, name = df.sparkSession, f"argloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name goes: the files are the shared folder's
    return out.hint("merge")


def beside(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with what other (one row a key; of more the largest) has of their keys: inner, left, semi or anti.

    Both meet in a window over the keys. A join over more keys than its tables are dealt
    by shuffles them anew, a window doesn't.
    """
    mine, more = ([c for c in df.columns if c not in keys] for df in (rows, other))
    more = more if how in ("inner", "left") else []
    # under names of their own, as Spark knows how a union is dealt only where the first side's keys are renamed
    named = {k: f"_{k}" for k in keys}
    key = [F.col(k).alias(n) for k, n in named.items()]
    known = F.when(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]), F.struct(F.lit(True).alias("_met"), *more))
    both = rows.select(*key, F.struct(F.lit(True).alias("_own"), *mine).alias("_row")).unionByName(other.select(*key, known.alias("_other")), allowMissingColumns=True)
    met = both.withColumn("_other", F.max("_other").over(Window.partitionBy(*named.values()))).where("_row IS NOT NULL")
    kept = met if how == "left" else met.where("_other IS NULL" if how == "anti" else "_other IS NOT NULL")
    return kept.select(*[F.col(n).alias(k) for k, n in named.items()], *[F.col(f"_row.{c}") for c in mine], *[F.col(f"_other.{c}") for c in more])
