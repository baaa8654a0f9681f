import random
import sys

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echocite.functions import editing
from echocite.operators import authors
from tests import plain

WORDS = st.text(alphabet="abcłé ", max_size=9)


def score(block, pairs):
    vocabulary = sorted({w for pair in pairs for w in pair})
    place = {w: k for k, w in enumerate(vocabulary)}
    left = np.array([place[a] for a, _ in pairs])
    right = np.array([place[b] for _, b in pairs])
    return editing.by_length(block, vocabulary, left, right).tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=20))
def test_batch_measures_equal_the_plain_ones(pairs):
    assert score(editing.osa_block, pairs) == [plain.osa(a, b) for a, b in pairs]
    assert score(editing.dl_block, pairs) == [plain.dl(a, b) for a, b in pairs]
    assert score(editing.jaro_block, pairs) == [plain.jaro(a, b) for a, b in pairs]
    assert score(editing.jaro_winkler_block, pairs) == [plain.jaro_winkler(a, b) for a, b in pairs]


def test_lengths_far_apart_and_slices(monkeypatch):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcd"), size)) for size in [0, 1, 2, 5, 40, 41, 90, 150, 3, 7] * 4]
    pairs = [(a, b) for a in texts[:12] for b in texts[12:]]
    monkeypatch.setattr(editing, "CELL_BUDGET", 64)
    assert score(editing.osa_block, pairs) == [plain.osa(a, b) for a, b in pairs]
    assert score(editing.jaro_winkler_block, pairs) == [plain.jaro_winkler(a, b) for a, b in pairs]


def test_built_in_distance_bounds(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(0, 12)))
    df = spark.createDataFrame([(word(), word()) for _ in range(3000)], "a string, b string")
    a, b = F.col("a"), F.col("b")
    measured = df.select(editing.osa_distance(a, b).alias("d"), editing.osa_distance(b, a).alias("r"), F.levenshtein(a, b).alias("l"))
    assert measured.filter((F.col("d") > F.col("l")) | (F.col("d") < F.ceil(F.col("l") / 2)) | (F.col("d") != F.col("r"))).isEmpty()


def run_udf(udf, rows):
    """Call the UDF's function on (main list, citing list) rows of (name, id) or None."""
    part = lambda k, f: pa.array(
        [None if r[k] is None else [a[f] for a in r[k]] for r in rows], pa.list_(pa.string())
    )
    return udf.func(part(0, 0), part(0, 1), part(1, 0), part(1, 1)).to_pylist()


def check_rows(rows):
    found = run_udf(authors.author_scores(jaro_winkler=True), rows)
    for row, result in zip(rows, found, strict=True):
        mains, citings = row[0] or [], row[1] or []
        best, pairs = plain.author_scores(mains, citings, plain.dl)
        assert result["dl"] == best
        assert result["dl4"] == round(best, 4)
        assert result["jw"] == plain.author_scores(mains, citings, plain.jaro_winkler)[0]
        assert [(p["m"], p["c"], p["score"]) for p in result["matches"]] == pairs
        assert [p["shown"] for p in result["matches"]] == [round(s, 3) for *_, s in pairs]


AUTHOR = st.tuples(st.sampled_from(["Novák Ján", "Novak Jan", "Novák J", "Ján Novák", "", "Kováč", "Kovac P"]), st.sampled_from(["", "1", "2"]))
LIST = st.one_of(st.none(), st.lists(AUTHOR, max_size=5))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(LIST, LIST), max_size=8))
def test_author_scores_equal_brute_force(rows):
    check_rows(rows)


def test_author_scores_in_small_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    names = ["Novák Ján", "Novak Jan", "Nvoák Ján", "Kováč Peter", "Kováčová Petra", "Smith John", "Smyth Jon"]
    person = lambda: (str(rng.choice(names)), str(rng.choice(["", "", "7", "8"])))
    rows = [([person() for _ in range(rng.integers(0, 30))], [person() for _ in range(rng.integers(0, 30))]) for _ in range(9)]
    monkeypatch.setattr(authors, "PAIR_BUDGET", 17)
    check_rows(rows)


def test_id_rule(spark):
    rows = [
        ([("Novák Ján", "1")], [("Novák Ján", "2")]),
        ([("Novák Ján", "1")], [("Smith John", "1")]),
        ([("Novák Ján", "1")], [("Novak Jan", "")]),
        ([("Novák Ján", "1")], []),
    ]
    author = "array<struct<name string, id string>>"
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, m {author}, c {author}")
    scores = authors.compare(authors.author_scores(), F.col("m"), F.col("c"))
    texts = authors.match_texts(F.col("s.matches"), F.col("m"), F.col("c"))
    found = df.withColumn("s", scores).select("k", F.col("s.dl").alias("dl"), texts.alias("t")).orderBy("k").collect()
    assert [(r.dl, r.t) for r in found] == [
        (0.0, []),
        (1.0, ["Novák Ján <-> Smith John (score: 1.0, method: ID)"]),
        (1.0, ["Novák Ján <-> Novak Jan (score: 1.0, method: DL)"]),
        (0.0, []),
    ]


def test_threshold_includes_its_value():
    a, b = "abcdefghijklmnopqrst", "abcdefghijklm1234567"
    (result,) = run_udf(authors.author_scores(), [([(a, "")], [(b, "")])])
    assert result["dl"] == 0.65
    assert len(result["matches"]) == 1


def test_three_digit_scores_print_as_in_python(spark):
    values = [round(k / 1000, 3) for k in range(650, 1001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(F.col("v").cast("string")).collect()] == [str(v) for v in values]


def test_decided_edges_send_nothing(spark):
    author = "array<struct<name string, id string>>"
    df = spark.createDataFrame([([("A", "")], [("A", "")], True), ([("A", "")], [("A", "")], False)], f"m {author}, c {author}, done boolean")
    scores = authors.compare(authors.author_scores(), F.col("m"), F.col("c"), unless=F.col("done"))
    rows = df.select(scores.alias("s")).select("s.dl", F.size("s.matches")).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0), (1.0, 1)]




def test_long_names_take_several_words():
    sys.setrecursionlimit(20_000)  # of the plain version
    rnd = random.Random(8)
    pairs = []
    for size in (1, 2, 63, 64, 65, 127, 128, 129, 200, 400):
        for _ in range(12):
            a = "".join(rnd.choice("abž\0") for _ in range(size))
            b = list(a)
            for _ in range(rnd.randrange(12)):
                k = rnd.randrange(len(b) + 1)
                b[k : k + rnd.randrange(3)] = rnd.choice([[], ["a"], b[k : k + 2][::-1], ["ž", "b"]])
            pairs += [(a, "".join(b)), (a, "".join(rnd.choice("ab") for _ in range(rnd.randrange(3 * size))))]
    assert score(editing.osa_block, pairs) == [plain.osa(a, b) for a, b in pairs]
    assert score(editing.osa_block, [(b, a) for a, b in pairs]) == [plain.osa(a, b) for a, b in pairs]
