"""Corpora: text files, run manifests, labelled pairs, paragraphs of web pages."""

from __future__ import annotations

import json
import os
import posixpath
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PAIRS = "document STRING, a ARRAY<BIGINT>, b ARRAY<BIGINT>, a_texte STRING, b_texte STRING, ecart BIGINT, etiquette STRING, durete STRING"


def read_texts(spark: SparkSession, path: str, recursive: bool = False, required: bool = False) -> DataFrame:
    """doc_id (file path) and text of the .txt files of a folder, line ends as they are; empty ones are left out. With ``required``, a folder without a .txt file is an error."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").option("recursiveFileLookup", recursive).text(path)
    if required and not files.inputFiles():
        raise ValueError(f"no .txt file in {path}")
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")).where(F.length("text") > 0)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as its file system names it, without links and steps back where it is local."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri()
    local, where = uri.getScheme() == "file", uri.getPath()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{os.path.realpath(where) if local else posixpath.normpath(where)}"


def guard(spark: SparkSession, source: str, output: str, protected: tuple[str, ...] = ()) -> None:
    """An error if writing to output would replace the source (output is the source or holds it), or if either lies in a protected folder."""
    a, b = qualified(spark, source), qualified(spark, output)
    inside = lambda p, folder: p == folder or p.startswith(folder.rstrip("/") + "/")
    if inside(a, b):
        raise ValueError(f"the output would replace its source: {b}")
    for folder in (qualified(spark, p) for p in protected):
        if inside(a, folder) or inside(b, folder):
            raise ValueError(f"protected folder, work on a copy: {folder}")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIRS).json(path)


def output_path(path: Column, kind: str = "ann") -> Column:
    """Where the result of a .txt file goes; anything else is an error."""
    return F.when(path.rlike(r"(?i)\.txt$"), F.regexp_replace(path, r"(?i)\.txt$", f".{kind}")).otherwise(F.raise_error(F.concat(F.lit("not a .txt file: "), path)))


def manifest(docs: DataFrame, outputs: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Per document: source_sha256, output_sha256, status, is_empty. outputs: doc_id, output (null: failed). With replies of a model (a row each), also llm_calls."""
    joined = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256")).join(outputs.select("doc_id", "output"), "doc_id", "left")
    ok = F.col("output").isNotNull()
    columns = ["doc_id", "source_sha256", F.when(ok, F.sha2("output", 256)).alias("output_sha256"), F.when(ok, "ok").otherwise("error").alias("status"), (ok & (F.col("output") == "")).alias("is_empty")]
    if replies is None:
        return joined.select(*columns)
    calls = replies.groupBy("doc_id").agg(F.count("*").alias("calls"))
    return joined.join(calls, "doc_id", "left").select(*columns, F.coalesce("calls", F.lit(0)).cast("long").alias("llm_calls"))


def recorded(spark: SparkSession, rows: DataFrame, path: str, source: str | None = None, **configuration) -> dict:
    """Writes rows of ``manifest`` as JSON to path/documents and the run's summary to path/summary, and returns that.

    The summary's counts are observed in the pass that writes, so the rows are worked out
    once; its duration is that of the pass. A path that would replace ``source`` is an error.
    """
    if source:
        guard(spark, source, path)
    calls = [F.sum("llm_calls").alias("llm_calls")] if "llm_calls" in rows.columns else []
    seen = Observation("manifest")
    watched = rows.observe(
        seen, F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if("is_empty").alias("empty"), *calls,
    )
    began = time.monotonic()
    watched.write.json(f"{path}/documents")
    told = {k: v or 0 for k, v in seen.get.items()} | {"duration_s": round(time.monotonic() - began, 3)}
    whole = json.dumps({"schema_version": 1, "configuration": configuration, "summary": told}, ensure_ascii=False)
    spark.range(1).select(F.lit(whole).alias("value")).coalesce(1).write.text(f"{path}/summary")
    return told


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if("is_empty").alias("empty"))


def paragraphs(pages: DataFrame, shortest: int = 160, longest: int = 420, cue: str | None = None, numbered: bool = False) -> DataFrame:
    """page_id, par_no, paragraph: texts of p elements outside script and style, in the length range, ending in a full stop (not after a semicolon), each text once a page. With ``numbered``, only those that open with a number of one or two digits and a full stop."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    inner = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(decoded(F.regexp_replace(x, r"(?s)<[^>]*>", "")), r"(?U)\s+", " ")))
    one = pages.select("page_id", F.posexplode(F.array_distinct(inner)).alias("par_no", "paragraph")).where(F.length("paragraph").between(shortest, longest) & F.col("paragraph").endswith(".") & ~F.col("paragraph").endswith(";."))
    one = one.where(F.col("paragraph").rlike(r"^\d{1,2}\.[\s\u00a0]+\S")) if numbered else one
    return one.where(F.col("paragraph").rlike(f"(?iuU){cue}")) if cue else one


def decoded(text: Column) -> Column:
    """The five predefined entities and the no-break space."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text
