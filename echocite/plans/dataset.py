"""Labelled dataset: citations of found articles with labels from sure signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocite.operators.shaping import since
from echocite.operators.skew import join_records
from echocite.operators.status import AUTOCITATION, ERRATUM, truth_label

DEFAULT_FROM = "2000-01-01"  # fixed value: lower date bound of a dataset


def _sides(works: DataFrame) -> list[tuple[DataFrame, str, str]]:
    def side(prefix: str) -> DataFrame:
        return works.select(*[F.col(c).alias(f"{prefix}_{c.removeprefix('work_')}") for c in ("work_id", "title", "authors")])

    return [(side("main"), "main_id", "inner"), (side("citing"), "citing_id", "inner")]


def label_edges(
    edges: DataFrame,
    works: DataFrame,
    from_date: str = DEFAULT_FROM,
    annotations: DataFrame | None = None,
    salted: bool | None = None,
) -> DataFrame:
    """Citations of every found main, authors or not, with label, confidence and reason.

    `annotations` (main_id, citing_id, label) fill missing labels. They join the edges
    before titles and author lists are attached, while rows are still short.
    """
    dated = since(edges, from_date)
    if annotations is None:
        chosen = dated.withColumn("_given", F.lit(None).cast("string"))
    else:
        given = annotations.select("main_id", "citing_id", F.col("label").alias("_given"))
        chosen = dated.join(given, ["main_id", "citing_id"], "left")
    joined = join_records(chosen, _sides(works), salted=salted)
    labelled = joined.withColumn("truth", truth_label(F.col("citing_title"), F.col("is_xml")))
    return labelled.select(
        F.col("citing_id").alias("id"),
        "main_title",
        "main_authors",
        "citing_title",
        "citing_authors",
        F.col("is_xml").alias("is_xml_autocitation"),
        F.upper(F.coalesce("truth.label", "_given")).alias("true_label"),
        F.col("truth.confidence").alias("_confidence"),
        F.col("truth.reason").alias("_reason"),
        F.col("main_id").alias("_main_article_id"),
    )


def evaluation_records(records: DataFrame) -> DataFrame:
    """Labelled records without the annotator's fields."""
    kept = [c for c in records.columns if not c.startswith("_")]
    return records.select(F.col("_main_article_id").alias("main_id"), *kept)


def annotate(records: DataFrame, annotations: DataFrame) -> DataFrame:
    """Fill missing labels of a dataset that was written before, and drop the annotator's fields."""
    given = annotations.select(
        F.col("main_id").alias("_main_article_id"), F.col("citing_id").alias("id"), F.col("label").alias("_given")
    )
    filled = records.join(given, ["_main_article_id", "id"], "left")
    return evaluation_records(filled.withColumn("true_label", F.upper(F.coalesce("true_label", "_given"))))


def label_stats(records: DataFrame, requests: DataFrame, works: DataFrame) -> DataFrame:
    """Records per label, and requested mains that were not found, as one row."""
    missing = join_records(requests, [(works.select("work_id"), "work_id", "left_anti")])
    skipped = missing.agg(F.count(F.lit(1))).scalar()
    label = F.coalesce("true_label", F.lit(""))
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(label == ERRATUM).alias("erratum"),
        F.count_if(label == AUTOCITATION).alias("autocitation_xml"),
        F.count_if(~label.isin(ERRATUM, AUTOCITATION)).alias("needs_review"),
    ).withColumn("skipped", skipped)
