"""Shards of nearly equal bytes, by way of a fixed number of virtual slots, in DataFrame functions only.

Records are hashed into slots, bytes are summed by slot, and a small map says which shard holds which slot. The map is
stored with a version; rebalancing appends a version that moves a few slots and leaves all others where they are.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from echocite.llm.common import row_key
from echocite.session import scratch_path, settle

SHARDS = 40
SLOTS = 4096
ROW_BYTES = 16  # that each record takes besides its text
TOLERANCE = 0.01

MAP_SCHEMA = StructType([StructField(c, LongType(), False) for c in ("version", "virtual_slot", "shard")])


def slot_of(columns: list[str], slots: int = SLOTS):
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("long")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, key, size, text_crc32, virtual_slot) of every row; a missing text has no bytes."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        row_key(id_col, text_col).alias("key"),
        (F.octet_length(data).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    return sized.withColumn("virtual_slot", slot_of(["key", "text_crc32"], slots))


def loads(sized: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of every slot in use: as many rows as there are slots, whatever the number of records."""
    totals = sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return [(r["virtual_slot"], r["bytes"], r["n"]) for r in totals.orderBy("virtual_slot").collect()]


def first_map(slot_loads: list[tuple[int, int, int]], shards: int = SHARDS) -> dict[int, int]:
    """Slot to shard: the heaviest slot first, each to the shard that is lightest by then."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for slot, size, _ in sorted(slot_loads, key=lambda x: (-x[1], x[0])):
        total, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (total + size, shard))
    return placed


def rebalance(
    held: dict[int, int], slot_loads: list[tuple[int, int, int]], shards: int, tolerance: float = TOLERANCE
) -> dict[int, int]:
    """The moves (slot to its new shard) that bring every shard near the mean; all other slots stay.

    Slots that `held` doesn't know, or whose shard is gone, are placed first. Then slots move from the heaviest shard to
    the lightest, the largest that fits, until they are within `tolerance` of the mean or no move helps.
    """
    size = {slot: n for slot, n, _ in slot_loads}
    now = {slot: held.get(slot, -1) for slot in size}
    total = [0] * shards
    for slot, shard in now.items():
        if 0 <= shard < shards:
            total[shard] += size[slot]
    for slot in sorted(size, key=lambda s: (-size[s], s)):
        if not 0 <= now[slot] < shards:
            now[slot] = min(range(shards), key=lambda s: (total[s], s))
            total[now[slot]] += size[slot]
    mean = sum(total) / max(shards, 1)
    own: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in now.items():
        own[shard].append(slot)
    while True:
        high = max(range(shards), key=lambda s: (total[s], -s))
        low = min(range(shards), key=lambda s: (total[s], s))
        if total[high] <= mean * (1 + tolerance) and total[low] >= mean * (1 - tolerance):
            break
        gap = total[high] - total[low]
        fits = [s for s in own[high] if 0 < size[s] < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(gap / 2 - size[s]), s))
        own[high].remove(slot)
        own[low].append(slot)
        total[high] -= size[slot]
        total[low] += size[slot]
        now[slot] = low
    return {slot: shard for slot, shard in now.items() if held.get(slot) != shard}


def write_version(spark: SparkSession, path: str, version: int, moves: dict[int, int]) -> None:
    """Append one version of a map: only slots that moved, one row each."""
    rows = [(version, slot, shard) for slot, shard in sorted(moves.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) as of a version, by default the last one."""
    rows = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is not None:
        rows = rows.filter(F.col("version") <= version)
    return rows.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def stored_map(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The last version and its map, slot to shard; 0 and an empty map where `path` holds none."""
    try:
        last = spark.read.schema(MAP_SCHEMA).parquet(path).agg(F.max("version")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        return 0, {}
    return last, {r["virtual_slot"]: r["shard"] for r in read_map(spark, path, last).collect()}


def assign(sized: DataFrame, slot_map: DataFrame) -> DataFrame:
    """`sized` with its shard and `slot`, a gapless number from 0 within the shard.

    A record's number is its place in its virtual slot after the records of the shard's earlier virtual slots, so no
    task sees more than a virtual slot. `slot_map` has as many rows as there are virtual slots.
    """
    counts = sized.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n")).join(slot_map, "virtual_slot")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("virtual_slot").orderBy("key", "text_crc32", "size")
    placed = sized.withColumn("place", F.row_number().over(inside) - 1)
    joined = placed.join(F.broadcast(starts), "virtual_slot")
    return joined.withColumn("slot", (F.col("start") + F.col("place")).cast("long")).drop("start", "place")


def shard_by_bytes(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = SLOTS,
    map_path: str | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, virtual_slot) of every row, with shards of nearly equal bytes.

    `map_path` is where the versioned map lies; where it holds none, or by default in a new folder, version 1 is made.
    A stored map is rebalanced for the slots in use now, new ones included, and what moves is appended as a new version.
    `slots` must be what the map was made with; `shards` may differ.
    Equal rows get different numbers in the same shard. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sized = settle(records(docs, id_col, text_col, slots), "records")
    path = map_path or scratch_path(spark, "slot-map")
    version, held = stored_map(spark, path) if map_path else (0, {})
    moves = rebalance(held, loads(sized), shards) if version else first_map(loads(sized), shards)
    if moves or not version:
        write_version(spark, path, version + 1, moves)
    placed = assign(sized, read_map(spark, path))
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot", "virtual_slot")
