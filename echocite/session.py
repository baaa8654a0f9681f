"""Session settings, shared scratch folder, and size estimates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = 16  # files may hold so many times fewer bytes than the rows that are read from them


def build_session(app: str = "echocite", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; anything in `conf` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Rows here are short and costly, so small shuffles should still use all cores.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in spark.checkpoint.dir.

    Only a local master may fall back on a folder of its own; elsewhere an unset
    folder is an error, because a machine-local path is lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="echocite-"))
    return _own_dir[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes within remove their shuffle files when they end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage at a table that outlives any executor, so that several readers
    share one evaluation. Not for results that are read once. What was shuffled for it is removed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame) -> bool:
    """True where `df` is within Spark's broadcast threshold: by Spark's own estimate, and by its rows' length as JSON.

    The estimate goes by the size of files, which is far too low where values repeat, so rows are measured as well,
    unless the estimate is so low that they fit all the same.
    """
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if limit <= 0:
        return False
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    size = int(str(size))
    if size > limit or size <= limit // PACKED:
        return size <= limit
    return (df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0) <= limit


def spread_scan(df: DataFrame) -> DataFrame:
    """Deal out the rows of a scan with fewer splits than the session has cores.

    For costly work per row on a table in few files. A large table has more splits than
    that and is left as it is. `df` must be a scan, perhaps projected or filtered.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
