"""Segments against a plain search, held-out accuracy, and awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echocite.llm import labelled, quality, queries, toxicity

SCHEMA = "doc_id long, text string, label int, score string, part string, toxic_score string"
AWKWARD = [(1, None), (2, ""), (3, " \n"), (4, "!!! ???"), (5, "word " * 100_000), (5, "tie"), (None, "no id"), (None, None), (6, "x"), (6, "x")]
SF = "/root/testdata/sf0.1"


def plain_segments(scores):
    """Segments by splitting at the best one again and again, which is what maximal segments are."""
    if not scores or max(scores) <= 0:
        return []
    best, where = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-9:
                best, where = total, (a, b)
    a, b = where
    left = plain_segments(scores[:a])
    right = [(x + b + 1, y + b + 1, s) for x, y, s in plain_segments(scores[b + 1 :])]
    return [*left, (a, b, best), *right]


@pytest.mark.parametrize("seed", range(300))
def test_segments_equal_the_plain_ones(seed):
    rnd = random.Random(seed)
    scores = [rnd.uniform(0.5, 4) if rnd.random() < 0.3 else -toxicity.DRIFT * rnd.choice([1]) for _ in range(rnd.randint(0, 40))]
    places = [k for k, s in enumerate(scores) if s > 0]
    mine = toxicity.maximal_segments(places, [scores[k] for k in places], toxicity.DRIFT)
    wanted = plain_segments(scores)
    assert [(a, b) for a, b, _ in mine] == [(a, b) for a, b, _ in wanted]
    assert np.allclose([s for *_, s in mine], [s for *_, s in wanted])


def area(rows, label):
    """The area under the curve, ties counted half."""
    good, bad = ([r.score for r in rows if r[label] == k] for k in (1, 0))
    both = sorted(good + bad)
    low, high = np.searchsorted(both, good, "left"), np.searchsorted(both, good, "right")
    return ((low + high + 1) / 2).sum() / (len(good) * len(bad)) - (len(good) + 1) / (2 * len(bad))


@pytest.mark.parametrize(
    "query, label, least, hits, passes",
    [(queries.op5_toxicity, "toxic", 0.95, 0.9, 0.99), (queries.op7_quality, "quality", 0.99, 0.97, 0.97)],
)
def test_held_out_accuracy(spark, query, label, least, hits, passes):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = query(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 500
    assert area(rows, label) >= least
    assert np.mean([r.predicted == 1 for r in rows if r[label] == 1]) >= hits
    assert np.mean([r.predicted == 0 for r in rows if r[label] == 0]) >= passes


@pytest.mark.parametrize("query, cut", [(queries.op5_toxicity, 0.5), (queries.op7_quality, 0.3)])
def test_results_agree_with_their_contract(spark, sf_dir, query, cut):
    rows = query(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    of = {}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert of.setdefault(texts[r.doc_id], r.score) == r.score
    held = spark.range(len(rows)).select("id", (F.crc32(F.col("id").cast("string")) % 5 == 0).alias("h"))
    held = {r.id: r.h for r in held.collect()}
    assert all(r.held_out == held[r.doc_id] for r in rows)


def test_labels_of_the_held_out_fold_change_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(labelled.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, turned)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_awkward_tables(spark, sf_dir, module):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = module.train(docs, labels)
    frame = spark.createDataFrame([(i, t, 1, "s", "p", "x") for i, t in AWKWARD], SCHEMA)
    rows = module.score(frame, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert module.score(frame.limit(0), model).collect() == []
    empty = module.train(docs.limit(0), labels.limit(0))
    assert len({r.score for r in module.score(frame, empty).collect()}) == 1
    one_kind = labels.withColumns({"toxic": F.lit(0), "quality": F.lit(1)})
    module.score(frame, module.train(docs, one_kind)).collect()
    odd = labels.withColumn("toxic", F.col("toxic") + 5).withColumn("quality", F.lit(None).cast("int"))
    module.score(frame, module.train(docs, odd)).collect()


def test_toxic_rows_go_and_others_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    frame = spark.createDataFrame([(i, t, 1, "s", "p", "x") for i, t in AWKWARD], SCHEMA)
    both = frame.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    kept = toxicity.drop_toxic(both, model)
    assert kept.columns == both.columns
    wanted = sorted((r.doc_id for r in toxicity.score(both, model).filter("predicted = 0").collect()), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == wanted
    assert toxicity.drop_toxic(frame, model).columns == frame.columns
    poor = quality.drop_poor(frame, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert poor.columns == frame.columns


def test_training_samples_are_bounded_and_settle_conflicts(spark):
    rows = [(k, k % 2) for k in range(50)] + [(1, 1), (1, 0), (None, 1), (2, None), (4, 7)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    found = labelled.training_sample(labels, "toxic", rows=20).collect()
    assert len(found) == 20 and len({r.doc_id for r in found}) == 20
    full = {r.doc_id: r.label for r in labelled.training_sample(labels, "toxic").collect()}
    assert all(full[k] == k % 2 for k in full) and None not in full


@pytest.mark.parametrize("rows", [400, 1200, 20_000])
def test_more_labels_find_more_toxic_documents(spark, rows):
    """Held-out recall at three sample sizes; each bound is above that of the size before."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, rows=rows)
    found = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    caught = np.mean([r.predicted == 1 for r in found if r.toxic == 1])
    assert caught >= {400: 0.5, 1200: 0.8, 20_000: 0.9}[rows]
    assert np.mean([r.predicted == 0 for r in found if r.toxic == 0]) >= 0.98


def test_many_rare_toxic_words(spark):
    """Every toxic document holds two of 150 words, so none of them is in more than a few per cent of the toxic ones."""
    rnd = random.Random(6)
    draw = lambda n: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(n)]
    common, rare = draw(3000), draw(150)
    docs = []
    for k in range(4000):
        words = [rnd.choice(common) for _ in range(rnd.choice([20, 60, 300]))]
        if k % 8 == 0:
            for word in rnd.sample(rare, 2):
                words.insert(rnd.randrange(len(words)), word)
        docs.append((k, " ".join(words), int(k % 8 == 0)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    recall = []
    for rows in (400, 1200, 3000):
        found = toxicity.score(frame, toxicity.train(frame, frame, rows=rows)).join(frame, "doc_id").filter("held_out").collect()
        recall.append(np.mean([r.predicted for r in found if r.toxic]))
        assert np.mean([r.predicted for r in found if not r.toxic]) <= 0.02
    assert recall == sorted(recall) and recall[-1] >= 0.85
