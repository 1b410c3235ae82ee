"""From raw documents to an encoded training mix, in five stages, each over all that the one before kept.

Defined cases, for all stages: a null text counts as an empty one; ids may be null or
repeat, and each row is decided on as a row; an empty table gives an empty table; columns
other than those of documents are dropped, whatever their names. What a stage keeps, it
keeps unchanged. Each stage's own cases are in its docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from argloom.llm import byte_bpe, exact_dedup, jaccard, mixing, toxicity
from argloom.llm.util import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. Empty and null texts stay; equal rows go or stay together; without toxic labels all stay."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for blanks, the smallest id stays, of repeated rows one; a null id stands last. Empty, blank and null texts: those that normalise alike are equal."""
    return exact_dedup.dedup(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word n-grams at 0.8, the smallest id of each group stays, of repeated rows one; a null id stands last. Texts without words are linked to nothing and stay; those of fewer than five words have one n-gram."""
    return jaccard.dedup(docs, n=5, threshold=0.8).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1, repeating, with three epochs at most. A null source is one, last in order; a source without words is not taken."""
    return mixing.sample(docs, weights=(5, 2, 1), max_epochs=3).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of each row of the mix; those of null and empty texts are of nothing."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL has no way to say toxicity scores, LSH candidates or BPE merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
