"""The measures as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from echocite.functions import editing
from echocite.functions.names import normalize_name

SQL_FUNCTIONS = {
    "normalize_name": normalize_name,
    "osa_distance": editing.osa_distance,
    "dl_similarity": editing.dl_similarity,
    "jaro_similarity": editing.jaro_similarity,
    "jaro_winkler_similarity": editing.jaro_winkler_similarity,
    "name_dl": editing.name_dl,
    "name_jaro_winkler": editing.name_jaro_winkler,
}


def register(spark: SparkSession) -> None:
    """Make the measures callable from SQL under the names above."""
    for name, function in SQL_FUNCTIONS.items():
        spark.udf.register(name, function)
