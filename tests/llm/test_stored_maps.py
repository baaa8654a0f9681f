"""Sharding by a map that was stored for a smaller table."""

from echocite.llm import sharding
from echocite.session import scratch_path
from tests.llm.test_sharding import check

SCHEMA = "doc_id long, text string"


def test_a_grown_table_keeps_every_row(spark):
    path = scratch_path(spark, "slot-map")
    docs = [(i, f"text {i} " * (i % 7 + 1)) for i in range(3000)]

    def placed(n, shards):
        frame = spark.createDataFrame(docs[:n], SCHEMA)
        return sharding.shard_by_bytes(frame, shards, map_path=path).collect()

    check(placed(300, 5), docs[:300], 5)
    first = {r.virtual_slot: r.shard for r in sharding.read_map(spark, path, 1).collect()}
    assert 0 < len(first) <= 300
    sizes = check(placed(3000, 5), docs, 5)
    assert max(sizes.values()) <= 1.03 * min(sizes.values())
    last, held = sharding.stored_map(spark, path)
    assert last == 2 and first.keys() < held.keys()
    stayed = sum(held[s] == k for s, k in first.items())
    assert stayed >= 0.6 * len(first)
    check(placed(3000, 5), docs, 5)
    assert sharding.stored_map(spark, path) == (2, held)  # nothing moves, so nothing is written
    check(placed(3000, 4), docs, 4)
    assert sharding.stored_map(spark, path)[0] == 3
