"""What goes to the driver, and how rows are dealt out, where tables in files are few bytes and many rows."""

import pytest
from pyspark.sql import functions as F

from echocite.operators.skew import join_records
from echocite.session import fits_broadcast, settle
from tests.test_oracles import rows


@pytest.fixture
def threshold(spark):
    """Broadcast up to 200 kB."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _tables(spark):
    """20,000 facts that are the same long text again and again, and 4,000 records of texts of their own."""
    text = F.repeat(F.lit("same "), 40)
    facts = spark.range(20_000).select((F.col("id") % 4000).cast("string").alias("key"), text.alias("text"), (F.col("id") % 3).alias("n"))
    records = spark.range(4000).select(F.col("id").cast("string").alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("name"))
    return facts, settle(records, "records")


def test_facts_are_never_broadcast(threshold):
    facts, records = _tables(threshold)
    assert fits_broadcast(settle(facts, "facts")) is False and not fits_broadcast(records)
    joined = join_records(facts, [(records, "key", "inner")])
    assert rows(joined) == rows(facts.join(records, "key"))
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_repeated_values_count_by_their_rows(threshold):
    facts, _ = _tables(threshold)
    written = settle(facts, "facts")
    assert int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 200 << 10
    assert not fits_broadcast(written)
    assert fits_broadcast(written.limit(10).select("key"))


@pytest.mark.parametrize("limit", ["200k", "50m"])
def test_costly_rows_are_dealt_to_enough_tasks(threshold, limit):
    threshold.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    facts, records = _tables(threshold)
    joined = join_records(facts, [(records, "key", "inner")], rows_per_task=1000)
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 20 and max(sizes) < 2000
    assert rows(joined) == rows(facts.join(records, "key"))
