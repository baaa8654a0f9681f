"""Vectors from titles against a plain version, and cuts with pairs on both sides."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from echocite.functions.title_terms import SLOTS, hashed_tfidf, with_title_vectors
from echocite.functions.vectors import cosine
from echocite.operators.status import full_status
from echocite.plans.detect import judge_edges

WORK = "work_id string, title string, authors array<struct<name:string,id:string>>"


def plain(titles, slots):
    distinct = {t for t in titles if t}
    found = Counter(w for t in distinct for w in {w for w in t.split(" ") if w})
    out = {}
    for t in distinct:
        vector = [0.0] * slots
        for w, n in Counter(w for w in t.split(" ") if w).items():
            slot = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % slots
            vector[slot] += n * (math.log((1 + len(distinct)) / (1 + found[w])) + 1)
        out[t] = vector
    return out


def test_vectors_equal_the_plain_ones(spark):
    titles = ["a b c", "a b", "a a a", "žlté kvety", "", "a b c", "x " * 40 + "y", " lead", "-"]
    frame = spark.createDataFrame([(t, 1) for t in titles] + [(None, 2)], "title_norm string, title_vector int")
    for slots in (3, SLOTS):
        mine = {r.title_norm: r.title_vector for r in hashed_tfidf(frame, slots=slots).collect()}
        wanted = plain(titles, slots)
        assert mine.keys() == wanted.keys()
        assert all(math.isclose(x, y, rel_tol=1e-12) for t in wanted for x, y in zip(mine[t], wanted[t]))
    assert hashed_tfidf(frame.limit(0)).collect() == []


def test_pairs_on_both_sides_of_the_cut(spark):
    base = "influence of water on the growth of very rare mountain flowers in the western part of the high tatras"
    titles = [base, base + " again", base.replace("water", "light").replace("rare", "common").replace("western", "eastern"), "short other title", "", None]
    works = spark.createDataFrame([(str(k), t, [(f"Author {k}", f"p{k}")]) for k, t in enumerate(titles)], WORK)
    held = with_title_vectors(works)
    assert held.columns == [*works.columns, "title_vector"] and held.count() == len(titles)
    vectors = {r.work_id: r.title_vector for r in held.collect()}
    assert vectors["4"] is None and vectors["5"] is None
    pairs = held.alias("a").crossJoin(held.alias("b")).select(
        F.concat("a.work_id", F.lit("-"), "b.work_id").alias("p"), cosine(F.col("a.title_vector"), F.col("b.title_vector")).alias("c")
    )
    of = {r.p: r.c for r in pairs.collect()}
    assert of["0-1"] > 0.9 > of["0-2"] > 0.6 > of["0-3"]
    edges = spark.createDataFrame([("0", str(k), False, None) for k in range(1, 6)], "main_id string, citing_id string, is_xml boolean, datestamp date")
    for cut, errata in ((0.9, {"1"}), (0.6, {"1", "2"}), (0.0, {"1", "2", "3"})):
        rows = full_status(judge_edges(edges, held, title_threshold=cut)).collect()
        assert {r.citing_id for r in rows if r.status == "ERRATUM"} == errata, cut
