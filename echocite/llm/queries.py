"""Named queries: every operator of this package over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echocite.llm import (
    fingerprint,
    lines,
    merkle,
    neighbours,
    packing,
    quality,
    secret_scan,
    sharding,
    simhash,
    substrings,
    toxicity,
    vector_codes,
    word_tokens,
)
from echocite.llm.common import id_of

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_tokens.encode_digests(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select(id_of("key").alias("doc_id"), "start", "length", id_of("source").alias("first_doc_id"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, names = lines.without_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform(names["deleted"], lambda s: F.concat_ws("-", s["first"], s["last"]))
    return cut.select(
        "doc_id",
        F.col(names["n_deleted"]).alias("n_deleted"),
        F.array_join(spans, " ").alias("deleted"),
        F.length(names["kept_text"]).alias("kept_chars"),
        F.sha2(names["kept_text"], 256).alias("kept_sha256"),
    )


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(_table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_errors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_fingerprint": op3_fingerprint,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_substrings": op6_substrings,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_lines": op9_lines,
    "op10_embeddings": op10_embeddings,
    "op11_secrets": op11_secrets,
    "op12_manifest": op12_manifest,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op11_secrets": secret_scan.ORACLE,
    "op12_manifest": merkle.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
