"""Per-article and per-run totals.

A report nests all citations of an article in one value; here counts and detail rows are
two tables, because one article may hold a third of all citations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocite.operators.skew import join_records
from echocite.operators.status import AUTOCITATION, ERRATUM

# Fixed value: the message for an article that cannot be processed.
UNAVAILABLE = "Záznam nenájdený alebo bez autorov"


def usable_works(works: DataFrame) -> DataFrame:
    """Works that can be a main article of a detection: they have an author."""
    return works.filter(F.size("authors") > 0)


def unavailable(requests: DataFrame, works: DataFrame) -> DataFrame:
    """Requests whose `work_id` is not found or has no authors, repeats included."""
    usable = usable_works(works).select("work_id")
    return join_records(requests, [(usable, "work_id", "left_anti")]).withColumn("error", F.lit(UNAVAILABLE))


def _count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def count_full(statuses: DataFrame) -> DataFrame:
    """All citations, and self-citations only, per main article."""
    return statuses.groupBy("main_id").agg(
        F.count(F.lit(1)).alias("total_processed"),
        _count_where(F.col("status") == AUTOCITATION).alias("autocitations_found"),
    )


def count_detected(judged: DataFrame, threshold: float) -> DataFrame:
    """All citations, flagged ones included, and detected entries: errata and self-citations."""
    by_score = ~F.col("is_erratum") & ~F.col("is_xml") & (F.col("score") >= threshold)
    return judged.groupBy("main_id").agg(
        F.count(F.lit(1)).alias("total_processed"),
        _count_where(F.col("is_erratum") | by_score).alias("entries_detected"),
    )


def per_article(works: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per usable work; a work without citations has zeros."""
    mains = usable_works(works).select(
        F.col("work_id").alias("main_id"),
        F.col("title").alias("main_title"),
        F.array_join(F.col("authors")["name"], "; ").alias("main_authors"),
    )
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != "main_id"]
    return mains.join(counts, "main_id", "left").select("main_id", "main_title", "main_authors", *numbers)


def answer_requests(requests: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per request, repeated ids included; an error where the id is not usable."""
    answers = summary.withColumnRenamed("main_id", "work_id").withColumn("_found", F.lit(True))
    joined = join_records(requests, [(answers, "work_id", "left")])
    error = F.when(F.col("_found").isNull(), UNAVAILABLE)
    return joined.withColumn("error", error).withColumnRenamed("work_id", "main_id").drop("_found")


def as_often_as_asked(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """`rows` of main articles, each as often as its article is requested; judged once, repeated here.

    Rows and columns that are not needed should be left out before: the rows are written, and dealt out with all
    their texts.
    """
    asked = requests.groupBy(F.col("work_id").alias("main_id")).agg(F.count(F.lit(1)).alias("_times"))
    joined = join_records(rows, [(asked, "main_id", "inner")])
    return joined.select(*rows.columns, F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("col")


def run_totals(requests: DataFrame, staging: DataFrame) -> DataFrame:
    """Requests and rows queued for confirmation, repeats included in both, as one row."""
    queued = staging.agg(_count_where(F.col("type") == AUTOCITATION)).scalar()
    return requests.agg(F.count(F.lit(1)).alias("total_requests")).withColumn("autocitations_queued", queued)


def detected_entries(staging: DataFrame) -> DataFrame:
    return staging.filter(F.col("type").isin(ERRATUM, AUTOCITATION))

