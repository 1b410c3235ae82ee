"""What the operators share: the shared folder, lineage cuts, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import pathlib
import shutil
import tempfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only where the session names none and all run on one machine (tests)."""
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
    """df, computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """rows with the columns of groups (one row a key; ``size``: its number of rows), nulls where a key has none.

    Groups that hold a ``share``-th of all rows or more are ``share`` at most, so they are
    broadcast, and no task gets all rows of one. Both sides should be cut.
    """
    total = max(1, rows.count())
    hot = F.broadcast(groups.where(F.col(size) * share >= total))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rest.join(groups, key, "left").unionByName(rows.join(hot, key))


def by_row(docs: DataFrame, kept: DataFrame, digested: Column) -> DataFrame:
    """The rows of docs whose number is in kept (row, sha), moved once; ``digested`` is the text of ``__row`` that sha digests, and another one is an error."""
    numbered = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), F.monotonically_increasing_id().alias("__n"))
    joined = numbered.join(kept.select(F.col("row").alias("__n"), F.col("sha").alias("__sha")), "__n")
    same = F.sha2(digested.cast("binary"), 256) == F.col("__sha")
    checked = F.when(same, F.col("__row")).otherwise(F.raise_error(F.lit("the plan of docs gave other rows when it ran again")))
    return joined.select(checked.alias("__row")).select("__row.*")


def n_words(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Remembered(dict):
    """Results by key, in two generations of at most ``limit`` keys: what is used again outlives what is not. Long keys are not held."""

    def __init__(self, of: Callable, limit: int = 250_000, longest: int = 40):
        self.of, self.limit, self.longest, self.old = of, limit, longest, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.of(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = pathlib.Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp()  # the driver's own; Spark serves the file to executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, f"{root.name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)


#: Bytes of a batch that Python works on at a time.
SLICE = 4 << 20


def slices(batches):
    """Batches in parts of about SLICE bytes, one row at least."""
    for b in batches:
        step = max(1, b.num_rows * SLICE // max(1, b.nbytes))
        for k in range(0, max(1, b.num_rows), step):
            yield b.slice(k, step)


def release() -> None:
    """Gives memory that a task has freed back to the machine: workers live on and serve other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)

    def whole(batches):
        try:
            yield from run(slices(batches))
        finally:
            release()

    return df.mapInArrow(whole, schema)
