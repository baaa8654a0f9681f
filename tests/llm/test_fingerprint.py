"""Weighted samples against a plain version, and their likeness against the true one."""

import hashlib
import math
from collections import Counter

import pytest
import xxhash

from echocite.llm import fingerprint, queries

SCHEMA = "doc_id long, text string, block string, place string, side int, signature string, key string"
MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(text, number=None):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h if number is None else xxhash.xxh64_intdigest((h).to_bytes(8, "little"), 42)


def words_of(text):
    text = text.strip(" \t\n\x0b\x0c\r")
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w] or [""]


def plain_signature(text, samples=fingerprint.SAMPLES):
    out = []
    counts = Counter(words_of(text))
    for number in range(samples):
        best = None
        for word, weight in counts.items():
            term = xxhash.xxh64_intdigest(word.encode(), 42)
            seed = fingerprint.sample_seed(number) & MASK
            h = xxhash.xxh64_intdigest((term ^ seed).to_bytes(8, "little"), 42)
            b = (h & 1023) / 1024
            u, v = (((h >> k & (1 << 13) - 1) + 0.5) / (1 << 13) for k in (10, 23))
            w, x = (((h >> k & (1 << 14) - 1) + 0.5) / (1 << 14) for k in (36, 50))
            r, c = -math.log(u * v), -math.log(w * x)
            t = math.floor((0.0 if weight == 1 else math.log(weight)) / r + b)
            whole = int(c * math.exp(r * (b - 1 - t)) * (1 << 26))
            value = whole << 32 | ((h ^ (t & MASK)) & 0xFFFFFFFF)
            best = value if best is None else min(best, value)
        out.append(f"{best & 0xFFFFFFFF:08x}")
    return "".join(out)


def alike(a, b):
    return sum(a[k : k + 8] == b[k : k + 8] for k in range(0, len(a), 8)) / (len(a) // 8)


def likeness(a, b):
    a, b = Counter(words_of(a)), Counter(words_of(b))
    return sum((a & b).values()) / sum((a | b).values())


def expected(rows):
    """Rows in order of successors: id, or for a missing one a hash of the text; then that hash."""

    def place(row):
        h = 42 if row[1] is None else xxhash.xxh64_intdigest(row[1].encode(), 42)
        return (row[0] if row[0] is not None else (h & ((1 << 62) - 1)) + (1 << 62), signed(h))

    rows = sorted(rows, key=place)
    out = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, other = map(plain_signature, (text, edited, following))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(text), digest, own, changed, alike(own, changed), alike(own, other)))
    return sorted(out, key=str)


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "é ü 中 é"), (5, "é ü 中 é"), (5, "tie by id"), (9, "a b " * 3000),
    (11, " lead and trail "), (12, "A\x0bB\x0cC"), (None, "no id"), (None, None), (20, "x"), (21, "x y z x y x"),
]


@pytest.mark.parametrize("rows", [AWKWARD, AWKWARD[:1], AWKWARD[4:6], []], ids=["all", "one", "same", "none"])
def test_awkward_rows_against_the_plain_version(spark, rows):
    frame = spark.createDataFrame([(i, t, "b", "p", 1, "s", "k") for i, t in rows], SCHEMA)
    mine = [tuple(r) for r in fingerprint.fingerprint_edits(frame).collect()]
    assert sorted(mine, key=str) == expected(rows)


def test_given_documents(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    order = sorted(rows)
    mine = {r.doc_id: r for r in queries.op3_fingerprint(spark, sf_dir).collect()}
    assert mine.keys() == rows.keys()
    errors = []
    for k, i in enumerate(order):
        text, following = rows[i], rows[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert mine[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert mine[i].near_next == alike(mine[i].fingerprint, mine[order[(k + 1) % len(order)]].fingerprint)
        errors.append(mine[i].near_edited - likeness(text, edited))
    assert abs(sum(errors) / len(errors)) < 0.02
    assert sum(map(abs, errors)) / len(errors) < 0.5 / math.sqrt(fingerprint.SAMPLES)
    same = {}
    for i, text in rows.items():
        assert same.setdefault(text, mine[i].fingerprint) == mine[i].fingerprint


def test_no_python_runs_on_executors(spark, sf_dir):
    plan = queries.op3_fingerprint(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mean_error_is_within_a_fixed_bound(spark):
    """The bound doesn't move with the number of samples."""
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    order = sorted(rows)
    mine = {r.doc_id: r.near_edited for r in queries.op3_fingerprint(spark, "/root/testdata/sf0.01").collect()}
    errors = []
    for k, i in enumerate(order):
        text, following = rows[i], rows[order[(k + 1) % len(order)]]
        half = len(text) // 2
        errors.append(abs(mine[i] - likeness(text, text[: len(text) - half] + following[:half])))
    assert fingerprint.SAMPLES >= 64
    assert sum(errors) / len(errors) < 0.055
    assert sorted(errors)[len(errors) * 95 // 100] < 0.14


def test_the_plan_stays_short(spark, sf_dir):
    plan = queries.op3_fingerprint(spark, sf_dir)._jdf.queryExecution()
    assert len(plan.optimizedPlan().toString()) < 100_000


@pytest.mark.parametrize("blocks", [1, 2, 3, 10, 97])
def test_blocks_are_ranges_of_the_key(spark, blocks):
    keys = spark.range(0, 5000, 7).selectExpr("id * id as key")
    found = sorted((r.key, r.block) for r in fingerprint.with_block(keys, fingerprint._bounds(keys, blocks)).collect())
    numbers = [b for _, b in found]
    assert numbers == sorted(numbers) and numbers[0] == 0 and len(set(numbers)) == blocks
