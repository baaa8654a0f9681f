"""The labelled dataset: reading and coercion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echocite.operators.shaping import coerce_authors

# Authors may be objects or bare strings, so they are read as variants.
FILE_SCHEMA = """
id string, main_title string, main_authors array<variant>, citing_title string, citing_authors array<variant>,
is_xml_autocitation boolean, true_label string, _main_article_id string
"""


def read_labelled(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """All records of a dataset; `one_array` reads files that hold a single JSON array."""
    raw = spark.read.option("multiLine", one_array).schema(FILE_SCHEMA).json(path)
    return coerce_records(raw)


def coerce_records(raw: DataFrame) -> DataFrame:
    """Authors as structs, flag false where missing, label in upper case. Unlabelled rows stay."""
    return raw.select(
        "id",
        F.col("_main_article_id").alias("main_id"),
        "main_title",
        coerce_authors(F.col("main_authors")).alias("main_authors"),
        "citing_title",
        coerce_authors(F.col("citing_authors")).alias("citing_authors"),
        F.coalesce("is_xml_autocitation", F.lit(False)).alias("is_xml_autocitation"),
        F.upper("true_label").alias("true_label"),
    )


def usable_records(records: DataFrame) -> DataFrame:
    """Records that have been labelled."""
    return records.filter(F.col("true_label").isNotNull())


def load_counts(records: DataFrame) -> DataFrame:
    """Labelled and skipped records, as one row."""
    return records.agg(
        F.count("true_label").alias("labelled"), F.count_if(F.col("true_label").isNull()).alias("skipped")
    )
