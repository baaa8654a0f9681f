"""From raw documents to packed token sequences, in stages that are written and read again one by one.

Every stage works on all rows the one before has kept, and what it decides takes effect: toxic documents go, repeated
lines go, one of each group of near copies stays, repeated passages go, and what is left is packed. `run` writes each
stage as Parquet below the folder that spark.checkpoint.dir names, so a lost executor never costs more than one stage.
Columns other than doc_id and text are handed on as they are; n_chars is set anew where a text changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echocite.llm import lines, packing, simhash, substrings, toxicity
from echocite.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labels beside the documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; documents that were nothing else are dropped."""
    return _counted(lines.drop_repeated_lines(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return simhash.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages; documents that were nothing else are dropped."""
    return _counted(substrings.drop_passages(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("lines", without_repeated_lines),
    ("simhash", without_near_copies),
    ("substrings", without_repeated_passages),
    ("packing", packed),
]

ORACLE_SQL = None  # hashes, tokens and trained scores have no SQL; tests compare with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
