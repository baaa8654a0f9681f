"""Two large tables of records are joined in one shuffle of the facts, and the result is that of plain joins."""

import pytest
from pyspark.sql import functions as F

from echocite.operators import skew
from echocite.operators.skew import join_records
from tests.test_oracles import rows


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _tables(spark):
    """Facts a third of which have main 7, some without a key or a record, and two tables of records."""
    main = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 40)
    facts = spark.range(4000).select(main.cast("string").alias("main"), (F.col("id") * 7 % 45).cast("string").alias("citing"), "id")
    names = spark.range(42).select(F.col("id").cast("string").alias("key"), F.array(F.col("id"), F.lit(None)).alias("tags"))
    return facts, names.withColumnsRenamed({"key": "main", "tags": "a"}), names.withColumnsRenamed({"key": "citing", "tags": "b"})


@pytest.mark.parametrize("hows", [("inner", "inner"), ("left", "inner"), ("inner", "left"), ("left_semi", "left_anti"), ("left", "left_semi")])
@pytest.mark.parametrize("hot", [10, 10_000])
def test_cells_give_the_plain_result(no_broadcast, hows, hot):
    facts, a, b = _tables(no_broadcast)
    plain = facts.join(a, "main", hows[0]).join(b, "citing", hows[1])
    joined = join_records(facts, [(a, "main", hows[0]), (b, "citing", hows[1])], rows_per_salt=hot)
    assert joined.columns == plain.columns
    assert rows(joined) == rows(plain)


def test_facts_move_once_and_without_records(no_broadcast):
    facts, a, b = _tables(no_broadcast)
    joined = join_records(facts, [(a, "main", "inner"), (b, "citing", "inner")])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 3 and "SortMergeJoin" not in plan


def test_a_hot_key_is_dealt_to_all_cells(no_broadcast):
    facts, a, b = _tables(no_broadcast)
    for key in (None, 7):  # all facts, and the hot key's only
        own = facts if key is None else facts.filter(F.col("main") == str(key))
        joined = skew._join_in_cells(own, [(a, "main", "left"), (b, "citing", "left")], (4, 4), 10)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 3 * sum(sizes) / 16


def test_more_copies_than_facts_are_not_made(no_broadcast):
    facts, a, b = _tables(no_broadcast)
    assert skew._cells(facts, a, b) == (3, 3)  # for 8 partitions
    assert skew._cells(facts.limit(100), a, b) is None


def test_shuffle_partitions_beyond_the_cores_make_no_copies(no_broadcast):
    before = no_broadcast.conf.get("spark.sql.shuffle.partitions")
    no_broadcast.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        facts, a, b = _tables(no_broadcast)
        assert skew._cells(facts, a, b) == (4, 4)  # for 8 cores, not (20, 20)
    finally:
        no_broadcast.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_keys_are_looked_for_in_full_groups_only(spark, monkeypatch):
    monkeypatch.setattr(skew, "KEY_GROUPS", 4)  # every group has many keys
    facts, _, _ = _tables(spark)
    assert [r.main for r in skew.hot_keys(facts, "main", 500).collect()] == ["7"]
    assert skew.hot_keys(facts, "main", 5000).isEmpty()
