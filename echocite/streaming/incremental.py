"""Detection over newly harvested edges only.

The lower date bound of a harvest is what makes it incremental; as a stream, the files
seen so far are that bound. Each micro-batch is judged as in a batch run and written to a
folder of its own, so a batch repeated after a failure replaces itself. Edges whose works
are not there yet wait beside it and are tried again with the next batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from echocite.operators.skew import join_records
from echocite.operators.status import full_status
from echocite.operators.summaries import usable_works
from echocite.plans.detect import judge_edges
from echocite.schemas import EDGE
from echocite.session import settle

BUCKETS = 32  # that pairs are dealt to; a batch reads only the buckets it touches


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def judged(spark: SparkSession, out: str) -> DataFrame:
    """The statuses that all batches wrote."""
    return spark.read.parquet(f"{out}/judged")


def waiting(spark: SparkSession, out: str, batch: int) -> DataFrame | None:
    """The edges that were left waiting after a batch."""
    return _read(spark, f"{out}/waiting/batch={batch}")


def judge_new_edges(works: DataFrame, edge_dir: str, out: str, checkpoint: str) -> StreamingQuery:
    """Judge the edge files that arrived since the last call, and edges that waited for their works, then stop.

    An edge harvested again is not judged again. `works` is read anew for every batch. A batch looks at earlier
    results only in the hash buckets that its own pairs fall in. Its edges are merged once, and once marked as ready or
    waiting, whatever reads them afterwards.
    """
    spark = works.sparkSession
    pair = ["main_id", "citing_id"]

    def judge(batch: DataFrame, number: int) -> None:
        held = waiting(spark, out, number - 1)
        edges = batch if held is None else batch.unionByName(held.select(batch.columns))
        fresh = edges.groupBy(*pair).agg(F.max("is_xml").alias("is_xml"), F.max("datestamp").alias("datestamp"))
        bucket = F.pmod(F.xxhash64(*pair), F.lit(BUCKETS)).cast("int")
        fresh = settle(fresh.withColumn("bucket", bucket), "fresh")
        earlier = _read(spark, f"{out}/judged")
        if earlier is not None:
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS numbers at most
            earlier = earlier.filter(F.col("bucket").isin(touched) & (F.col("batch") < number))
            fresh = fresh.join(earlier.select("bucket", *pair), ["bucket", *pair], "left_anti")
        here = F.lit(True)
        usable = usable_works(works).select(F.col("work_id").alias("main_id")).distinct().withColumn("main_here", here)
        known = works.select(F.col("work_id").alias("citing_id")).distinct().withColumn("citing_here", here)
        marked = join_records(fresh, [(usable, "main_id", "left"), (known, "citing_id", "left")])
        both = (F.col("main_here") & F.col("citing_here")).isNotNull()
        marked = settle(marked.withColumn("ready", both).drop("bucket", "main_here", "citing_here"), "marked")
        ready, left = (marked.filter(own).drop("ready") for own in (F.col("ready"), ~F.col("ready")))
        left.write.mode("overwrite").parquet(f"{out}/waiting/batch={number}")
        rows = full_status(judge_edges(ready, works)).withColumn("bucket", bucket)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/judged/batch={number}")

    stream = spark.readStream.schema(EDGE).parquet(edge_dir)
    writer = stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
