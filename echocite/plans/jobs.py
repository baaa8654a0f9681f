"""The jobs a user runs: each reads tables and writes its results below one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echocite.operators import raw, status, summaries
from echocite.operators.authors import AUTHOR_THRESHOLD
from echocite.operators.shaping import merge_citations, newest_works
from echocite.operators.skew import join_records
from echocite.plans import dataset, detect
from echocite.session import settle
from echocite.sources import runlog, sinks


def detect_full(
    requests: DataFrame,
    works: DataFrame,
    citations: DataFrame,
    out: str,
    from_date: str = detect.DEFAULT_FROM,
    run_ts: Column | None = None,
) -> None:
    """Status of every citation of the requested mains.

    Writes `details` (a row per citation), `articles` (a row per request, errors
    included), and adds the run to `run_log`.
    """
    chosen, works = merge_citations(detect.requested_edges(citations, requests)), newest_works(works)
    rows = settle(status.full_status(detect.judge_citations(chosen, works, from_date)), "statuses")
    answers = settle(
        summaries.answer_requests(requests, summaries.per_article(works, summaries.count_full(rows))), "answers"
    )
    sinks.write_json(rows, f"{out}/details")
    sinks.write_json(answers, f"{out}/articles")
    runlog.append_run(answers, f"{out}/run_log", run_ts)


def detect_only(
    requests: DataFrame,
    works: DataFrame,
    citations: DataFrame,
    out: str,
    from_date: str = detect.DEFAULT_FROM,
) -> None:
    """Errata and self-citations not yet flagged.

    Writes `entries` (a row each), `articles`, `queue` (self-citations to
    confirm) and `totals`. Unusable mains are left out, and no run is logged.
    """
    chosen, works = merge_citations(detect.requested_edges(citations, requests)), newest_works(works)
    judged = settle(detect.judge_citations(chosen, works, from_date, skip_flagged=True), "judged")
    staging = summaries.as_often_as_asked(summaries.detected_entries(status.detected_status(judged)), requests)
    counts = summaries.count_detected(judged, AUTHOR_THRESHOLD)
    asked = requests.select(F.col("work_id").alias("main_id")).distinct()
    articles = summaries.per_article(works, counts).join(asked, "main_id", "left_semi")
    sinks.write_json(staging.select("main_id", "citing_id", "type", "citing_title", "matches"), f"{out}/entries")
    sinks.write_json(articles, f"{out}/articles")
    sinks.write_work_queue(status.work_queue(staging), f"{out}/queue")
    sinks.write_json(summaries.run_totals(requests, staging), f"{out}/totals")


def build_dataset(
    requests: DataFrame, works: DataFrame, edges: DataFrame, out: str, from_date: str = dataset.DEFAULT_FROM
) -> None:
    """Labelled records of the requested mains as `dataset`, and their counts as `stats`.

    A dataset takes the loose flag: shape its citations with `loose=True`.
    """
    records = settle(dataset.label_edges(detect.requested_edges(edges, requests), works, from_date), "labelled")
    sinks.write_labelled(records, f"{out}/dataset")
    sinks.write_json(dataset.label_stats(records, requests, works), f"{out}/stats")


def export_raw(requests: DataFrame, citations: DataFrame, raw_records: DataFrame, out: str) -> None:
    """Raw records of the requested `mains`, and of their `citations`, a row each."""
    records = settle(raw.as_json(raw_records), "records")
    chosen = detect.requested_edges(citations, requests)
    sinks.write_json(raw.export_mains(requests, records), f"{out}/mains")
    sinks.write_json(raw.export_citations(chosen, records), f"{out}/citations")


def edges_of(citations: DataFrame) -> DataFrame:
    """Edges of harvested citations, repeated ones merged."""
    return citations.groupBy("main_id", "citing_id").agg(
        F.max("is_xml").alias("is_xml"), F.max("datestamp").alias("datestamp")
    )


def works_of(citations: DataFrame, mains: DataFrame) -> DataFrame:
    """One record per work out of main records and harvested citing records.

    A main record wins over a harvested copy; among copies the newest does.
    """
    copies = citations.groupBy(F.col("citing_id").alias("work_id")).agg(
        F.max(F.struct("datestamp", "title", "authors")).alias("r")
    )
    flat = copies.select("work_id", "r.title", "r.authors")
    others = join_records(flat, [(mains.select("work_id"), "work_id", "left_anti")])
    return mains.select("work_id", "title", "authors").unionByName(others)
