"""Documents as a stream: they are independent, so extraction keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from argloom.operators import graph
from argloom.operators.segment import segments
from argloom.sources import brat


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id BIGINT, text STRING", fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def segment_stream(docs: DataFrame) -> DataFrame:
    """Segments of streamed documents; a projection, so append mode works."""
    return segments(docs)


def annotate_stream(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes doc_id and annotation of each micro-batch to a folder per batch, so that a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        tables = brat.tables(graph.extract(df), df)
        brat.render(*tables).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
