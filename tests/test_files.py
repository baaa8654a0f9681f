import csv
import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echocite.functions.editing import jaro_winkler_by, pair_column
from echocite.functions.registry import register
from echocite.functions.vectors import cosine, embed_titles
from echocite.operators import status, summaries
from echocite.operators.citation_strings import split_fields
from echocite.operators.errata import with_title_forms
from echocite.operators.evaluation import best_row, method_winner, threshold_grid, winner_marks
from echocite.plans import dataset, detect, experiments, jobs
from echocite.sources import labelled, requests, runlog, sinks
from echocite.streaming.incremental import judge_new_edges
from echocite.streaming.incremental import judged as judged_edges

AUTHOR = "array<struct<name string, id string>>"


def lines(path, pattern="part-*"):
    return [line for f in sorted(path.glob(pattern)) for line in f.read_text(encoding="utf-8").splitlines()]


@pytest.fixture(scope="module")
def works(spark):
    rows = [
        ("1000", "Flowers", [("Novák Ján", "p1"), ("Kováč Peter", "")]),
        ("1001", "Trees", [("Novak Jan", ""), ('Smith "J", Jr', "")]),
        ("1002", "flowers", [("Other", "p2")]),
        ("1003", "Correction to trees", [("Other", "p2")]),
        ("1004", "Empty", []),
        ("1005", "Rivers", [("Kovac Peter", "p7")]),
        ("1006", "Lakes", [("Nobody", "p8")]),
    ]
    return spark.createDataFrame(rows, f"work_id string, title string, authors {AUTHOR}")


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        ("1000", "1001", False, "2025-01-01"),
        ("1000", "1002", False, "2025-02-01"),
        ("1000", "1003", True, "2025-02-01"),
        ("1000", "1005", False, "2025-02-01"),
        ("1000", "1006", True, "2025-02-01"),
        ("1001", "1006", False, "2025-02-01"),
        ("1004", "1006", False, "2025-02-01"),
        ("1001", "1000", False, "2024-12-31"),
    ]
    raw = spark.createDataFrame(rows, "main_id string, citing_id string, is_xml boolean, d string")
    return raw.select("main_id", "citing_id", "is_xml", F.to_timestamp("d").alias("datestamp"))


def test_statuses_and_summaries(works, edges):
    judged = detect.judge_edges(edges, works, from_date=detect.DEFAULT_FROM)
    full = {(r.main_id, r.citing_id): r for r in status.full_status(judged).collect()}
    assert {k: r.status for k, r in full.items()} == {
        ("1000", "1001"): "AUTOCITATION",
        ("1000", "1002"): "ERRATUM",
        ("1000", "1003"): "ERRATUM",
        ("1000", "1005"): "AUTOCITATION",
        ("1000", "1006"): "AUTOCITATION",
        ("1001", "1006"): "NOT AUTOCITATION",
    }
    assert full["1000", "1001"].matched_authors == ["Novák Ján <-> Novak Jan (score: 1.0, method: DL)"]
    assert full["1000", "1002"].score is None and full["1000", "1002"].note
    assert full["1000", "1006"].all_citation_authors == ["Nobody"]

    staging = status.detected_status(detect.judge_edges(edges, works, from_date="2025-01-01", skip_flagged=True))
    types = {(r.main_id, r.citing_id): r.type for r in staging.collect()}
    assert ("1000", "1006") not in types and types["1000", "1003"] == "ERRATUM"
    assert {(r.mainArticleId, r.citingId) for r in status.work_queue(staging).collect()} == {("1000", "1001"), ("1000", "1005")}

    counts = summaries.count_detected(detect.judge_edges(edges, works, from_date="2025-01-01"), 0.65)
    per = {r.main_id: (r.total_processed, r.entries_detected) for r in summaries.per_article(works, counts).collect()}
    assert per["1000"] == (5, 4) and per["1001"] == (1, 0) and per["1002"] == (0, 0) and "1004" not in per

    full_counts = summaries.per_article(works, summaries.count_full(status.full_status(judged)))
    wanted = works.sparkSession.createDataFrame([(1, "1000"), (2, "1000"), (3, "1004"), (4, "9999")], "n int, work_id string")
    answers = summaries.answer_requests(wanted, full_counts).orderBy("n").collect()
    assert [(a.n, a.main_id, a.autocitations_found, a.error is None) for a in answers] == [
        (1, "1000", 3, True),
        (2, "1000", 3, True),
        (3, "1004", None, False),
        (4, "9999", None, False),
    ]
    assert summaries.unavailable(wanted, works).count() == 2
    assert tuple(summaries.run_totals(wanted, staging).first()) == (4, 2)


def test_salted_detection_is_the_same(works, edges):
    plain = status.full_status(detect.judge_edges(edges, works)).collect()
    salted = status.full_status(detect.judge_edges(edges, works, salted=True, rows_per_salt=1)).collect()
    assert sorted(map(str, plain)) == sorted(map(str, salted))


def test_work_queue_file(spark, works, edges, tmp_path):
    queue = status.work_queue(status.detected_status(detect.judge_edges(edges, works, skip_flagged=True)))
    sinks.write_work_queue(queue.orderBy("citingId"), str(tmp_path / "q"))
    rows = [r for f in sorted((tmp_path / "q").glob("part-*")) for r in csv.reader(f.open(encoding="utf-8"))]
    header = ["mainArticleId", "mainArticleTitle", "citingId", "citingTitle", "matches"]
    assert rows[0] == header
    assert [r[2] for r in rows if r != header] == ["1000", "1001", "1005"]
    sinks.write_work_queue(queue.filter("false"), str(tmp_path / "empty"))
    assert lines(tmp_path / "empty") == [",".join(header)]


def test_quotes_in_the_queue(spark, tmp_path):
    row = ("1", 'A "b", c', "2", "t", "m")
    queue = spark.createDataFrame([row], "a string, b string, c string, d string, e string")
    sinks.write_work_queue(queue.coalesce(1), str(tmp_path / "q"))
    (part,) = (tmp_path / "q").glob("part-*")
    assert list(csv.reader(part.open(encoding="utf-8")))[1] == list(row)


def test_ids_from_text_and_file(spark, tmp_path):
    df = spark.createDataFrame([("x 1234;5678, 12 99999 1234",), ("no id 123",)], "request string")
    assert [(r.pos, r.work_id) for r in requests.request_ids(df).collect()] == [(0, "1234"), (1, "5678"), (2, "99999"), (3, "1234")]
    (tmp_path / "ids.txt").write_text(" 1234 \n\n  \n5678\n")
    assert [r.work_id for r in requests.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["1234", "5678"]


def test_dataset_and_annotations(spark, works, edges, tmp_path):
    records = dataset.label_edges(edges, works)
    labels = {(r._main_article_id, r.id): (r.true_label, r._confidence) for r in records.collect()}
    assert len(labels) == 8  # mains without authors take part
    assert labels["1000", "1003"] == ("ERRATUM", "HIGH") and labels["1000", "1006"] == ("AUTOCITATION", "HIGH")
    assert labels["1000", "1002"] == (None, "NEEDS_REVIEW")
    wanted = spark.createDataFrame([("1000",), ("9999",), ("9999",)], "work_id string")
    assert tuple(dataset.label_stats(records, wanted, works).first()) == (8, 1, 1, 6, 2)

    sinks.write_labelled(records, str(tmp_path / "d"))
    written = [json.loads(line) for line in lines(tmp_path / "d")]
    assert all("true_label" in r for r in written) and any(r["true_label"] is None for r in written)
    assert "Novák" in "".join(lines(tmp_path / "d"))
    loaded = labelled.read_labelled(spark, str(tmp_path / "d"))
    assert tuple(labelled.load_counts(loaded).first()) == (2, 6)

    notes = spark.createDataFrame([("1000", "1001", "autocitation"), ("1000", "1003", "ignored")], "main_id string, citing_id string, label string")
    filled = {(r.main_id, r.id): r.true_label for r in dataset.annotate(records, notes).collect()}
    assert filled["1000", "1001"] == "AUTOCITATION" and filled["1000", "1003"] == "ERRATUM"


def test_loader_accepts_loose_records(spark, tmp_path):
    records = [
        {"id": 7, "main_title": "M", "main_authors": ["Novák Ján", {"name": "X", "id": " 5 "}, {"name": "Y"}], "citing_title": "",
         "citing_authors": [], "true_label": "not_autocitation"},
        {"id": "8", "main_title": "M", "main_authors": [], "citing_title": "C", "citing_authors": ['{"name"', 12], "true_label": None},
    ]
    (tmp_path / "one.json").write_text(json.dumps(records, indent=2), encoding="utf-8")
    loaded = labelled.read_labelled(spark, str(tmp_path / "one.json"), one_array=True)
    assert tuple(labelled.load_counts(loaded).first()) == (1, 1)
    (row,) = labelled.usable_records(loaded).collect()
    assert (row.id, row.true_label, row.is_xml_autocitation) == ("7", "NOT_AUTOCITATION", False)
    assert [(a.name, a.id) for a in row.main_authors] == [("Novák Ján", ""), ("X", "5"), ("Y", "")]
    odd = loaded.filter("id = '8'").first()
    assert [(a.name, a.id) for a in odd.citing_authors] == [('{"name"', ""), ("12", "")]


def test_threshold_grid_and_ties(spark):
    assert threshold_grid() == [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
    rows = spark.createDataFrame([(0.4, 0.5), (0.3, 0.5), (0.5, 0.1)], "threshold double, f1 double")
    assert best_row(rows, "f1", "threshold").first().threshold == 0.3
    both = spark.createDataFrame([(0.3, 0.5, 0.5), (0.4, 0.5, 0.2)], "threshold double, jw_f1 double, dl_f1 double")
    assert tuple(method_winner(both).first()) == (0.3, 0.5, 0.3, 0.5, "Jaro-Winkler", 0.0)
    assert [r.better for r in winner_marks(both, ["jw", "dl"]).orderBy("threshold").collect()] == ["", "jw"]


def test_experiments_write_their_files(spark, works, edges, tmp_path):
    notes = edges.select("main_id", "citing_id", F.when(F.col("citing_id") == "1001", "AUTOCITATION").otherwise("NOT_AUTOCITATION").alias("label"))
    records = dataset.annotate(dataset.label_edges(edges, works), notes)
    vectors = embed_titles(with_title_forms(works), lambda: lambda titles: [[float(len(t)), 1.0] for t in titles])
    assert {r.title_norm: len(r.title_vector) for r in vectors.collect()}["flowers"] == 2
    prepared = experiments.with_norms(records)
    for side in ("main", "citing"):
        named = vectors.select(F.col("title_norm").alias(f"{side}_norm"), F.col("title_vector").alias(f"{side}_vector"))
        prepared = prepared.join(named, f"{side}_norm", "left")
    models = {"length": cosine(F.col("citing_vector"), F.col("main_vector")), "never": F.lit(0.0)}
    experiments.run_experiments(prepared, models, str(tmp_path))
    reports = [json.loads(line) for line in lines(tmp_path / "errata_model_comparison")]
    assert [r["model_name"] for r in reports] == ["length", "never"]
    assert reports[1]["confusion_matrix"] == {"tp": 1, "fp": 1, "tn": 4, "fn": 0}
    assert all(r["infer_time_s"] > 0 for r in reports)
    sweep_rows = list(csv.reader(lines(tmp_path / "autocitation_threshold_sweep")))
    assert sweep_rows[0] == ["DL prah", "Precision", "Recall", "F1", "Accuracy", "TP", "FP", "TN", "FN"]
    assert [float(r[0]) for r in sweep_rows[1:]] == threshold_grid()
    method_rows = list(csv.reader(lines(tmp_path / "method_comparison_jw_vs_dl")))
    assert method_rows[0][:3] == ["Prah", "JW_Precision", "JW_Recall"] and len(method_rows) == 15
    (combined,) = [json.loads(line) for line in lines(tmp_path / "experiment_results")]
    assert len(combined["experiment_B_dl_sweep"]) == len(combined["experiment_C_method_comparison"]) == 14
    assert len(combined["experiment_A_errata_models"]) == 2
    errors = [json.loads(line) for line in lines(tmp_path / "errata_errors" / "model=never")]
    assert [(e["type"], e["id"]) for e in errors] == [("FP_ERRATA", "1002")]


def test_parity_feeds_edit_distance_to_both_sides(spark, works, edges):
    notes = edges.select("main_id", "citing_id", F.lit("NOT_AUTOCITATION").alias("label"))
    scored = experiments.score_records(dataset.annotate(dataset.label_edges(edges, works), notes))
    for row in experiments.method_sweep(scored, parity=True).collect():
        assert [row[f"jw_{c}"] for c in ("tp", "fp", "tn", "fn")] == [row[f"dl_{c}"] for c in ("tp", "fp", "tn", "fn")]


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("select name_dl('Novák', 'NVOAK') a, osa_distance('ca', 'abc') b, normalize_name(' É ') c").first()
    assert tuple(row) == (0.8, 3, "e")


def test_prefix_weight(spark):
    double = pair_column(jaro_winkler_by(0.2), T.DoubleType())
    row = spark.range(1).select(double(F.lit("abxyz"), F.lit("abqrs")).alias("s")).first()
    assert row.s == pytest.approx(0.6 + 2 * 0.2 * 0.4)


def citations_of(edges, works):
    return edges.join(works.withColumnRenamed("work_id", "citing_id"), "citing_id")


def test_full_job(spark, works, edges, tmp_path):
    wanted = spark.createDataFrame([("1000",), ("1004",), ("1000",)], "work_id string")
    stamp = F.lit("2026-01-02 03:04:05").cast("timestamp")
    jobs.detect_full(wanted, works, citations_of(edges, works), str(tmp_path), run_ts=stamp)
    details = {json.loads(x)["citing_id"]: json.loads(x) for x in lines(tmp_path / "details")}
    assert {k: v["status"] for k, v in details.items()} == {
        "1001": "AUTOCITATION",
        "1002": "ERRATUM",
        "1003": "ERRATUM",
        "1005": "AUTOCITATION",
        "1006": "AUTOCITATION",
    }
    by_edges = status.full_status(detect.judge_edges(edges.filter("main_id = '1000'"), works, "2025-01-01")).collect()
    assert {r.citing_id: r.status for r in by_edges} == {k: v["status"] for k, v in details.items()}
    articles = [json.loads(x) for x in lines(tmp_path / "articles")]
    assert sorted((a["main_id"], a.get("autocitations_found")) for a in articles if "error" not in a) == [("1000", 3)] * 2
    assert [a["main_id"] for a in articles if "error" in a] == ["1004"]
    assert runlog.read_runs(spark, str(tmp_path / "run_log")).count() == 3


def test_detected_only_job(spark, works, edges, tmp_path):
    wanted = spark.createDataFrame([("1000",), ("1001",), ("9999",)], "work_id string")
    jobs.detect_only(wanted, works, citations_of(edges, works), str(tmp_path))
    entries = [json.loads(x) for x in lines(tmp_path / "entries")]
    assert {e["main_id"] for e in entries} == {"1000"}
    assert sorted((e["citing_id"], e["type"]) for e in entries) == [
        ("1001", "AUTOCITATION"),
        ("1002", "ERRATUM"),
        ("1003", "ERRATUM"),
        ("1005", "AUTOCITATION"),
    ]
    assert {(a["main_id"], a["total_processed"], a["entries_detected"]) for a in map(json.loads, lines(tmp_path / "articles"))} == {
        ("1000", 5, 4),
        ("1001", 1, 0),
    }
    assert [json.loads(x) for x in lines(tmp_path / "totals")] == [{"total_requests": 3, "autocitations_queued": 2}]


def test_dataset_and_raw_jobs(spark, works, edges, tmp_path):
    wanted = spark.createDataFrame([("1000",), ("9999",)], "work_id string")
    jobs.build_dataset(wanted, works, edges, str(tmp_path))
    assert len(lines(tmp_path / "dataset")) == 5
    assert json.loads(lines(tmp_path / "stats")[0]) == {
        "total": 5, "erratum": 1, "autocitation_xml": 1, "needs_review": 3, "skipped": 1,
    }
    raw_records = spark.createDataFrame([("1000", '<r><rec_biblio id="1000"/></r>')], "record_id string, xml string")
    jobs.export_raw(wanted, edges, raw_records, str(tmp_path))
    mains = {m["main_id"]: json.loads(m["full_record"]) for m in map(json.loads, lines(tmp_path / "mains"))}
    assert mains == {"1000": {"id": "1000"}, "9999": {"error": "Záznam nedostupný"}}
    assert len(lines(tmp_path / "citations")) == 5


def test_works_and_edges_of_a_harvest(works, edges):
    citations = citations_of(edges, works)
    twice = citations.unionByName(citations.withColumn("is_xml", F.lit(False)))
    assert jobs.edges_of(twice).count() == edges.count()
    assert sorted(map(str, jobs.edges_of(twice).select(edges.columns).collect())) == sorted(map(str, edges.collect()))
    mains = works.filter("work_id in ('1000', '1004')")
    merged = jobs.works_of(twice, mains)
    assert sorted(map(str, merged.collect())) == sorted(map(str, works.collect()))


def test_run_log(spark, works, tmp_path):
    path = str(tmp_path / "log")
    assert runlog.read_runs(spark, path).count() == 0
    summary = spark.createDataFrame([("1000", "Flowers", 5, 3)], "main_id string, main_title string, total_processed bigint, autocitations_found bigint")
    runlog.append_run(summary, path)
    runlog.append_run(summary, path, F.lit("2026-01-02 03:04:05").cast("timestamp"))
    runs = runlog.read_runs(spark, path)
    assert runs.count() == 2 and runs.select("run_date").distinct().count() == 2


def test_new_edges_are_judged_once(spark, works, edges, tmp_path):
    inbox, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    edges.filter("main_id = '1000'").write.parquet(inbox)
    judge_new_edges(works, inbox, out, state).awaitTermination()
    assert judged_edges(spark, out).count() == 5
    edges.write.mode("append").parquet(inbox)
    judge_new_edges(works, inbox, out, state).awaitTermination()
    judge_new_edges(works, inbox, out, state).awaitTermination()
    rows = judged_edges(spark, out)
    assert rows.count() == 7 and rows.select("main_id", "citing_id").distinct().count() == 7


def test_edges_wait_for_late_works(spark, works, edges, tmp_path):
    inbox, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    edges.filter("main_id = '1000'").write.parquet(inbox)
    judge_new_edges(works.filter("work_id != '1002'"), inbox, out, state).awaitTermination()
    assert judged_edges(spark, out).count() == 4
    edges.filter("main_id != '1000'").write.mode("append").parquet(inbox)
    judge_new_edges(works, inbox, out, state).awaitTermination()
    rows = judged_edges(spark, out)
    assert rows.count() == 7 and rows.select("main_id", "citing_id").distinct().count() == 7


def test_repeated_mains_and_citations_are_judged_once(spark, works, edges, tmp_path):
    wanted = spark.createDataFrame([("1000",)], "work_id string")
    citations = citations_of(edges, works)
    older = citations.withColumns({"datestamp": F.lit(None).cast("timestamp"), "title": F.lit("zz older")})
    jobs.detect_full(wanted, works.unionByName(works), citations.unionByName(older), str(tmp_path))
    details = [json.loads(x) for x in lines(tmp_path / "details")]
    assert len(details) == 5 and "zz older" not in {d["citing_title"] for d in details}


def test_scores_are_computed_once_under_a_filter(works, edges):
    queue = status.work_queue(status.detected_status(detect.judge_edges(edges, works, skip_flagged=True)))
    plan = queue._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_errata_by_vectors(spark, works, edges):
    vectors = [(str(1000 + k), [1.0, k / 10.0]) for k in range(7)]
    table = spark.createDataFrame(vectors, "work_id string, title_vector array<float>")
    judged = detect.judge_edges(edges, works.join(table, "work_id"), title_threshold=0.999)
    assert {(r.main_id, r.citing_id) for r in judged.filter("is_erratum").collect()} == {
        ("1000", "1002"),
        ("1000", "1003"),
    }
    loose = detect.judge_edges(edges, works.join(table, "work_id"), title_threshold=0.90)
    assert ("1000", "1001") in {(r.main_id, r.citing_id) for r in loose.filter("is_erratum").collect()}


def test_citation_fields(spark):
    cases = {
        "Roč. 12, č. 3 (2019), s. 45–50": {"volume": "12", "issue": "3", "year": "2019", "startPage": "45", "endPage": "50"},
        "ol. 7, iss. 2, p. 9, ISBN? Nno 5": None,
        "Vol. l, No. 4 (2020), s. 8, doi 10.1234/ab.c na CD": {"volume": "1", "issue": "4", "year": "2020", "format": "CD-ROM", "page": "8", "doi": "10.1234/ab.c"},
        "Vol. 3, Číslo článku 77, suppl. 2": {"volume": "3", "articelNumber": "77", "supplement": "2"},
        "": {},
    }
    df = spark.createDataFrame([(k, s) for k, s in enumerate(cases)], "k int, inputString string")
    rows = split_fields(df).orderBy("k").collect()
    for row, (text, fields) in zip(rows, cases.items(), strict=True):
        if fields is not None:
            assert json.loads(row.data) == fields, text
            assert row.errorCode is None and row.unhandledInput is None
    assert rows[1].errorCode == 10001 and rows[1].unhandledInput


def test_remainder_rules(spark):
    df = spark.createDataFrame([("Vol. 3, 77x8", None), ("Vol. 3, 77x8", 1200), ("Vol. 3, 7", 1)], "inputString string, err int")
    rows = split_fields(df, excluded=["7"], error="err").collect()
    assert [(r.errorCode, r.unhandledInput) for r in rows] == [(10001, "77x8"), (1200, "77x8"), (1, None)]


@pytest.mark.parametrize("column", ["data", "inputString", "errorCode", "unhandledInput"])
def test_filters_on_split_fields_plan_quickly(spark, column):
    df = spark.createDataFrame([(1, "vol. 7, no. 2 x7y")], "k int, inputString string")
    started = time.time()
    split_fields(df).filter(F.col(column).isNotNull())._jdf.queryExecution().executedPlan()
    assert time.time() - started < 10
