"""The run log: an append-only table in place of a file that is read and rewritten."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echocite.schemas import RUN_LOG
from echocite.sources.committed import write_committed


def _stamped(summary: DataFrame, run_ts: Column | None) -> DataFrame:
    stamped = summary.withColumn("run_ts", F.current_timestamp() if run_ts is None else run_ts)
    dated = stamped.withColumn("run_date", F.to_date("run_ts"))
    present = [f.name if f.name in dated.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RUN_LOG]
    return dated.select(*present)


def append_run(summary: DataFrame, path: str, run_ts: Column | None = None) -> None:
    """Add one run's article rows. Earlier runs are neither read nor rewritten."""
    _stamped(summary, run_ts).write.mode("append").partitionBy("run_date").parquet(path)


def commit_run(summary: DataFrame, path: str, run_ts: Column | None = None) -> None:
    """The same as JSON lines that count only once the whole run is written; `read_committed` reads them."""
    write_committed(_stamped(summary, run_ts), path, "json", "append")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs so far; none where there is no log yet. A damaged file is an error, not a run less."""
    reader = spark.read.schema(RUN_LOG)
    try:
        return reader.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN_LOG)
