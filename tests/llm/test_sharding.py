"""Shards of nearly equal bytes, gapless numbers, and maps whose versions differ by few moves."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from echocite.llm import queries, sharding
from echocite.session import scratch_path

SCHEMA = "doc_id long, text string, key string, size string, shard string, slot string, virtual_slot int"


def check(rows, docs, shards):
    wanted = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == wanted
    places, sizes = defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r.shard < shards
        places[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return sizes


def test_given_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op8_sharding(spark, sf_dir).collect()
    sizes = check(rows, docs, 40)
    largest = max(len(t.encode()) + 16 for _, t in docs)
    mean = sum(sizes.values()) / 40
    assert max(sizes.values()) <= max(largest, 1.1 * mean)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_awkward_rows_and_clashing_columns(spark):
    docs = [(1, None), (2, ""), (3, "é" * 100), (3, "é" * 100), (3, "x"), (None, None), (None, "y"), (4, "z" * 100_000)]
    frame = spark.createDataFrame([(i, t, "k", "s", "h", "l", 1) for i, t in docs], SCHEMA)
    check(sharding.shard_by_bytes(frame, shards=3).collect(), docs, 3)
    assert sharding.shard_by_bytes(frame.limit(0)).collect() == []


def test_shards_are_nearly_equal_over_many_slots():
    rnd = random.Random(1)
    slots = [(k, rnd.randint(1, 1000), 1) for k in range(4096)]
    placed = sharding.first_map(slots, 40)
    totals = Counter()
    for slot, size, _ in slots:
        totals[placed[slot]] += size
    assert max(totals.values()) - min(totals.values()) <= 20


@pytest.mark.parametrize("shards", [40, 41, 37])
def test_rebalancing_moves_little(shards):
    rnd = random.Random(2)
    slots = [(k, rnd.randint(500, 1000), 1) for k in range(4096)]
    held = sharding.first_map(slots, 40)
    moves = sharding.rebalance(held, slots, shards)
    now = {**held, **moves}
    totals = Counter()
    for slot, size, _ in slots:
        totals[now[slot]] += size
    mean = sum(totals.values()) / shards
    assert set(totals) == set(range(shards))
    assert max(totals.values()) <= 1.02 * mean and min(totals.values()) >= 0.98 * mean
    assert len(moves) <= {40: 0, 41: 130, 37: 420}[shards]


def test_maps_are_read_as_of_a_version(spark):
    path = scratch_path(spark, "slot-map")
    sharding.write_version(spark, path, 1, {0: 0, 1: 1, 2: 0})
    sharding.write_version(spark, path, 2, {2: 1})
    assert {tuple(r) for r in sharding.read_map(spark, path).collect()} == {(0, 0), (1, 1), (2, 1)}
    assert {tuple(r) for r in sharding.read_map(spark, path, 1).collect()} == {(0, 0), (1, 1), (2, 0)}


def test_no_python_runs_on_executors(spark, sf_dir):
    plan = queries.op8_sharding(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
