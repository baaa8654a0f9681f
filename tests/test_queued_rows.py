"""What a run repeats for its requests: rows to confirm only, and no text that isn't used."""

import pytest

from echocite.operators import skew
from echocite.plans.catalog import CATALOG


@pytest.mark.parametrize(
    ("name", "texts"), [("run_totals", set()), ("requested_queue", {"main_title", "citing_title", "matches"})]
)
def test_only_rows_to_confirm_are_written_for_their_requests(spark, sf_dir, monkeypatch, name, texts):
    written, settle = [], skew.settle

    def kept(df, label):
        table = settle(df, label)
        if "type" in table.columns:
            written.append(table)
        return table

    monkeypatch.setattr(skew, "settle", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        CATALOG[name](spark, sf_dir).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (table,) = written
    assert {r.type for r in table.select("type").distinct().collect()} <= {"AUTOCITATION"}
    assert set(table.columns) <= {"main_id", "citing_id", "type"} | texts
