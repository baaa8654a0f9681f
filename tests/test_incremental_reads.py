"""How often a batch of new edges is read."""

from pyspark.sql import functions as F

from echocite.schemas import EDGE
from echocite.streaming import incremental

WORK = "work_id string, title string, authors array<struct<name:string,id:string>>"


def test_a_batch_is_read_once_and_each_edge_is_ready_or_waiting(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    works = spark.createDataFrame([(str(k), f"T {k}", [("Nagy Jan", "")] if k else []) for k in range(8)], WORK)
    edges = [("1", "2", False, None), ("0", "1", False, None), ("3", "9", True, None), (None, "1", False, None), ("1", "2", True, None)]
    for number, own_works in enumerate((works, works.filter("work_id < '3'"), works)):
        own = edges if number == 0 else [("4", str(number + 4), False, None)]
        spark.createDataFrame(own, EDGE).coalesce(1).write.mode("append").parquet(inbox)
        query = incremental.judge_new_edges(own_works, inbox, out, state)
        query.awaitTermination()
        batch = [p for p in query.recentProgress if p["numInputRows"]]
        assert [p["numInputRows"] for p in batch] == [len(own)]
        left = incremental.waiting(spark, out, number)
        assert sorted(left.columns) == ["citing_id", "datestamp", "is_xml", "main_id"]
        ids = left.select(F.coalesce("main_id", F.lit("-")), "citing_id").collect()
        late = [("4", "5")] if number == 1 else []
        assert sorted(map(tuple, ids)) == sorted([("-", "1"), ("0", "1"), ("3", "9"), *late])
    done = incremental.judged(spark, out).select("main_id", "citing_id", "status").collect()
    assert sorted(map(tuple, done)) == [(m, c, "AUTOCITATION") for m, c in (("1", "2"), ("4", "5"), ("4", "6"))]
