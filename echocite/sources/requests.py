"""Identifier lists: from free text, and from a file with one per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echocite.functions.titles import strip

ID_PATTERN = r"(\d{4,})"  # fixed value: every run of four or more digits is an id


def request_ids(requests: DataFrame, text: str = "request", keep: list[str] | None = None) -> DataFrame:
    """(kept columns, pos, work_id): ids in order of mention, repeats kept."""
    found = F.regexp_extract_all(F.col(text), F.lit(ID_PATTERN), F.lit(1))
    return requests.select(*(keep or []), F.posexplode(found).alias("pos", "work_id"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line; blank lines are skipped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("work_id"))
    return lines.filter(F.length("work_id") > 0)
