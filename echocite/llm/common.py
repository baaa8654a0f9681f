"""What several operators of this package need: names, keys, batch sizes, splits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 500
NO_ID = 1 << 62  # stand-ins for missing ids start here, beyond any real id, so that they sort last


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send whole texts to Python a few at a time, so that a batch of long ones stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns made by a generator, so that the optimizer doesn't repeat them where they are used."""
    name = fresh(df, "made")
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(name)
    return df.select("*", made).select(*df.columns, f"{name}.*")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id of a row, or for a missing id a stand-in from the text that sorts after every id."""
    stand_in = F.xxhash64(text_col).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    return F.coalesce(F.col(id_col).cast("long"), stand_in)


def id_of(key: str | Column) -> Column:
    """The id that a row key stands for; NULL for a stand-in."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key < NO_ID, key)


def tasks_for(rows: float, rows_per_task: int, spark: SparkSession) -> int:
    """Partitions of at most about `rows_per_task` rows, and no fewer than shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-rows // rows_per_task)))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, missing ones as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, missing ones as empty."""
    return [x or "" for x in column.to_pylist()]


def merged(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of one partition as a table; for partitions whose size is bounded by design."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None
