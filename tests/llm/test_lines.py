"""Repeated runs of lines against a plain version that looks at one line after another."""

import random

import pytest
import xxhash

from echocite.llm import lines, queries

SCHEMA = "doc_id long, text string, row string, runs string, full int, kept_text string, at long"
BLANKS = " \t\x0b\x0c\r"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def text_hash(text):
    return signed(42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42))


def chain(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v & ((1 << 64) - 1)).to_bytes(8, "little"), h)
    return signed(h)


def plain(docs, gram=1, window=1, min_chars=lines.MIN_CHARS):
    """{(id, text): (kept text, deleted line numbers)}; as it stands, by every line, without windows or extension"""
    places = {}
    for i, text in set(docs):
        h = text_hash(text)
        key = i if i is not None else (h & ((1 << 62) - 1)) + (1 << 62)
        full = [(k, x.strip(BLANKS)) for k, x in enumerate((text or "").split("\n")) if x.strip(BLANKS)]
        places[(key, h)] = ((i, text), full, [text_hash(x) for _, x in full])
    chosen = []
    for place, (_, _, hashes) in places.items():
        grams = [chain(hashes[k : k + gram]) for k in range(len(hashes) - gram + 1)]
        starts = range(max(len(grams) - window, 0) + 1) if grams else []
        picked = {min((grams[j], -j) for j in range(s, min(s + window, len(grams)))) for s in starts}
        chosen += [(g, *place, -j) for g, j in picked]
    first = {}
    for g, *place in sorted(chosen):
        first.setdefault(g, tuple(place))
    out = {}
    for place, (doc, full, hashes) in places.items():
        gone = set()
        for g, *at in chosen:
            if tuple(at[:2]) != place or first[g] == tuple(at):
                continue
            other, j, k = places[first[g][:2]][2], first[g][2], at[2]
            left = right = 0
            while left < window - 1 and k - left > 0 and j - left > 0 and hashes[k - left - 1] == other[j - left - 1]:
                left += 1
            while (
                right < window - 1
                and k + gram + right < len(hashes)
                and j + gram + right < len(other)
                and hashes[k + gram + right] == other[j + gram + right]
            ):
                right += 1
            gone.update(range(k - left, k + gram + right))
        runs, run = [], []
        for k in range(len(full) + 1):
            if k in gone:
                run.append(k)
            elif run:
                runs.append(run)
                run = []
        cut = set()
        for run in runs:
            if sum(len(full[k][1]) for k in run) >= min_chars:
                cut.update(range(full[run[0]][0], full[run[-1]][0] + 1))
        text = doc[1]
        if cut:
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in cut)
        out[doc] = (text, sorted(cut))
    return out


def compare(spark, docs):
    frame = spark.createDataFrame([(i, t, "r", "u", 1, "k", 2) for i, t in docs], SCHEMA)
    cut, names = lines.without_runs(frame)
    assert cut.columns[: len(frame.columns)] == frame.columns
    wanted = plain(docs)
    rows = cut.collect()
    assert len(rows) == len(docs)
    for r in rows:
        text, gone = wanted[(r.doc_id, r.text)]
        assert r[names["kept_text"]] == text
        assert [k for s in r[names["deleted"]] for k in range(s["first"], s["last"] + 1)] == gone
        assert r[names["n_deleted"]] == len(gone)
    kept = lines.drop_repeated_lines(frame)
    assert kept.columns == frame.columns
    left = [t for d in docs for t, gone in [wanted[d]] if not gone or t.strip(BLANKS + "\n")]
    assert sorted((r.text for r in kept.collect()), key=str) == sorted(left, key=str)


LINE = ["a line of some length number %d here" % k for k in range(40)]


def test_given_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    wanted = plain(docs)
    rows = queries.op9_lines(spark, sf_dir).collect()
    assert {r.doc_id: r.n_deleted for r in rows} == {i: len(wanted[(i, t)][1]) for i, t in docs}
    assert sum(r.n_deleted for r in rows) > 0


AWKWARD = [
    (1, None), (2, ""), (3, "\n\n"), (4, "\n".join(LINE[:6])), (5, "x\n" + "\n".join(LINE[1:5]) + "\ny"),
    (5, "\n".join(LINE[:6])), (5, "\n".join(LINE[:6])), (6, "\n\n ".join(LINE[2:6]) + "\n"), (7, LINE[0]), (8, LINE[0]),
    (9, "\n".join([LINE[7]] * 5000)), (None, "\n".join(LINE[:3])), (None, None), (11, "a\nb\na\nb\na\nb"),
    (12, "\r\n".join(LINE[8:12])), (13, "\n".join(LINE[8:12])),
]


def test_awkward_rows_and_clashing_columns(spark):
    compare(spark, AWKWARD)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert lines.without_runs(frame)[0].collect() == [] and lines.drop_repeated_lines(frame).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_random_documents(spark, seed):
    rnd = random.Random(seed)
    docs = []
    for i in range(60):
        own = [rnd.choice(LINE[:14]) if rnd.random() < 0.8 else f"line of its own {rnd.random()}" for _ in range(rnd.randint(0, 12))]
        docs.append((i, "\n".join(own)))
    compare(spark, docs)


def test_runs_as_long_as_the_guarantee_leave_no_whole_repeat(spark):
    run = LINE[20 : 20 + lines.GRAM + lines.WINDOW - 1]
    docs = [(i, "\n".join([f"head of {i} only"] + run + [f"tail of {i} only"])) for i in range(30)]
    wanted = plain(docs)
    assert [len(wanted[d][1]) for d in docs] == [0] + [len(run)] * 29
    compare(spark, docs)


def test_no_python_runs_on_executors(spark, sf_dir):
    plan = queries.op9_lines(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("gram,window", [(1, 2), (2, 4), (3, 3)])
def test_runs_of_grams_equal_the_plain_ones(spark, gram, window):
    """What fingerprints of grams find by themselves, with their extension."""
    rnd = random.Random(gram)
    docs = []
    for i in range(50):
        a = rnd.randrange(20)
        own = [rnd.choice(LINE[:14]) if rnd.random() < 0.5 else f"line of its own {rnd.random()}" for _ in range(rnd.randint(0, 9))]
        docs.append((i, "\n".join(own + LINE[a : a + rnd.randrange(16)] + own[:3])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marked = lines.line_hashes(frame)
    found = {r.key: {k for s in r.runs for k in range(s["first"], s["end"])} for r in lines.gram_runs(marked, gram, window).collect()}
    wanted = {d[0]: set(gone) for d, (_, gone) in plain(docs, gram, window, 0).items() if gone}
    assert found == wanted
    seen = {}
    for i, text in docs:  # runs of this length that an earlier document has share a fingerprint with it
        own = text.split("\n")
        size = gram + window - 1
        for k in range(len(own) - size + 1):
            if seen.setdefault(tuple(own[k : k + size]), i) != i:
                assert set(range(k, k + size)) & found[i]


def test_one_line_in_every_document_is_split(spark):
    """A plan in which no group of equal lines is bound to one task: the first places are a table of their own."""
    docs = [(i, f"{LINE[3]} and more of it to be long\nown {i}") for i in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    cut, names = lines.without_runs(frame)
    assert cut.filter(f"{names['n_deleted']} = 1").count() == 1999
