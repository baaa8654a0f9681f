"""Packing documents into sequences of a fixed number of tokens, as a cutting-stock problem.

A document is cut into whole sequences and one remainder. Remainders are counted by length in units; a linear program
over patterns (which lengths share a sequence) is solved by column generation, where a knapsack prices new patterns,
and rounded down; the few lengths left over are packed first-fit decreasing. Documents are ranked within their length,
and ranks are dealt to patterns. Lengths are rounded up to units, so sequences have a little room left: it is filled
with pieces of some whole sequences, cut to fit. What is left of the last of these is cut at powers of two, so that
nothing is padded unless there are too few whole sequences to fill all room.

Only the histogram (as many numbers as units fit a sequence) and the patterns (a few for each length) are on the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echocite.llm.byte_tokens import byte_tokens
from echocite.llm.common import row_key, small_batches, strings
from echocite.session import settle

ROOM = 2048
UNIT = 32
END_ID = 1
RANK_ROWS = 50_000  # rows that one task ranks at a time
ROUNDS = 4000  # of column generation; stopping early only costs some padding

PIECE = "piece long, key long, text_hash long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# --- patterns, from counts alone


def _best_pattern(prices: np.ndarray, sizes: list[int], room: int) -> tuple[float, np.ndarray]:
    """The most valuable way to fill `room` with items of `sizes`, by dynamic programming over room."""
    value, took = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        value[r], took[r] = value[r - 1], -1
        for k, size in enumerate(sizes):
            if size <= r and value[r - size] + prices[k] > value[r] + 1e-12:
                value[r], took[r] = value[r - size] + prices[k], k
    pattern, r = np.zeros(len(sizes), int), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            pattern[took[r]] += 1
            r -= sizes[took[r]]
    return value[room], pattern


def _first_fit(counts: Counter, room: int) -> Counter:
    """Patterns of a few items, longest first into the first sequence that has room."""
    bins: list[list[int]] = []
    left: list[int] = []
    for size in sorted(counts.elements(), reverse=True):
        at = next((k for k, r in enumerate(left) if r >= size), None)
        if at is None:
            bins.append([])
            left.append(room)
            at = len(bins) - 1
        bins[at].append(size)
        left[at] -= size
    return Counter(tuple(sorted(b, reverse=True)) for b in bins)


def patterns(counts: dict[int, int], room: int) -> Counter:
    """How often to use each pattern (sizes, longest first) so that every item is in exactly one sequence."""
    sizes = sorted(size for size, n in counts.items() if n)
    if not sizes:
        return Counter()
    need = np.array([counts[s] for s in sizes], float)
    basis = np.diag([float(room // s) for s in sizes])
    amount = need / np.diag(basis)
    for _ in range(ROUNDS):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = _best_pattern(prices, sizes, room)
        if value <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        amount = np.maximum(np.linalg.solve(basis, need), 0)
    used: Counter = Counter()
    left = need.astype(int)
    for k in np.argsort(-amount):
        column = np.rint(basis[:, k]).astype(int)
        fits = min(left[column > 0] // column[column > 0])
        times = int(min(np.floor(amount[k] + 1e-9), fits))
        if times > 0:
            left -= times * column
            used[tuple(s for s, n in sorted(zip(sizes, column.tolist()), reverse=True) for _ in range(n))] += times
    return used + _first_fit(Counter(dict(zip(sizes, left.tolist()))), room)


def _dealt(used: Counter) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(size, first rank, rank after the last, items in a sequence, first sequence) rows, and the number of sequences."""
    rows, rank, sequence = [], Counter(), 0
    for pattern, times in sorted(used.items(), reverse=True):
        for size, n in sorted(Counter(pattern).items()):
            rows.append((size, rank[size], rank[size] + n * times, n, sequence))
            rank[size] += n * times
        sequence += times
    return rows, sequence


# --- pieces


def _cut_pieces(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = byte_tokens(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            keys, hashes, ids = (batch.column(k).to_pylist() for k in range(3))
            for key, text_hash, doc_id, text in zip(keys, hashes, ids, strings(batch.column(3))):
                data = tokens.encode(text) + end
                total = len(data) // 4
                for at in range(0, total, ROOM):
                    part = data[4 * at : 4 * (at + ROOM)]
                    rows.append((key, text_hash, doc_id, at, len(part) // 4, zlib.crc32(part), total))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7
            names = ["key", "text_hash", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _cut_again(path: str | None):
    """Pieces of whole sequences that were cut to fill room: the documents' ids are made a second time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = byte_tokens(path), np.array([END_ID], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows: list[tuple] = []
            ids, cuts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc_id, text, own in zip(ids, strings(batch.column(1)), cuts):
                data = tokens.encode(text) + end
                for cut in own:
                    a, n = cut["start"], cut["length"]
                    crc = zlib.crc32(data[4 * a : 4 * (a + n)])
                    rows.append((doc_id, a, n, crc, len(data) // 4, cut["sequence_id"], cut["offset"]))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _ranked(pieces: DataFrame, group: str, rows: int) -> DataFrame:
    """`pieces` with a gapless rank from 0 within `group`. Each group is dealt to buckets that one task can sort;
    the rank is the place in the bucket after the rows of the buckets before it."""
    buckets = max(1, -(-rows // RANK_ROWS))
    held = pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "text_hash"), F.lit(buckets)))
    counts = held.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy(group, "bucket").orderBy("key", "text_hash", "start", "piece")
    placed = held.withColumn("place", F.row_number().over(own) - 1)
    joined = placed.join(offsets, [group, "bucket"])
    return joined.withColumn("rank", F.col("before") + F.col("place")).drop("bucket", "before", "place")


def _with_room(sequences: DataFrame, count: int) -> DataFrame:
    """(sequence_id, used, room, before): room of all earlier sequences, as a running sum in two levels."""
    held = sequences.withColumn("block", F.floor(F.col("sequence_id") / RANK_ROWS))
    blocks = held.groupBy("block").agg(F.sum("room").alias("of_block"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for 50,000 sequences
    starts = blocks.select("block", F.coalesce(F.sum("of_block").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("block").orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, -1)
    running = held.withColumn("inside", F.coalesce(F.sum("room").over(inside), F.lit(0)))
    return running.join(starts, "block").withColumn("before", F.col("start") + F.col("inside"))


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece.

    Every id of every row's text (a missing one counts as empty) and an end id are in exactly one piece; pieces of a
    sequence lie gapless from offset 0 and have at most 2048 ids together. `path` names the vocabulary. Rows with the
    same id and text are packed as often as they are there. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key, text_hash = row_key(id_col, text_col), F.xxhash64(text_col)
    narrow = docs.select(
        key.alias("key"), text_hash.alias("text_hash"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)
    )
    cut = narrow.mapInArrow(_cut_pieces(path), PIECE.split(", ", 1)[1])
    pieces = settle(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    size = F.ceil(F.col("length") / UNIT).cast("int")
    ends = pieces.filter(F.col("length") < ROOM).withColumn("size", size)
    counts = {r["size"]: r["n"] for r in ends.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = pieces.filter(F.col("length") == ROOM).withColumn("size", F.lit(0))
    n_whole, n_ends = whole.count(), sum(counts.values())

    rows, n_mixed = _dealt(patterns(counts, ROOM // UNIT))
    deal = spark.createDataFrame(rows, "size int, lo long, hi long, each long, base long")
    ranked = _ranked(ends, "size", n_ends).alias("p")
    deal = F.broadcast(deal.alias("d"))  # a few rows for each size and pattern, so a few thousand at most
    on = (F.col("p.size") == F.col("d.size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    sequence = F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))
    mixed = ranked.join(deal, on).select("p.*", sequence.cast("long").alias("sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "piece")
    offset = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    mixed = settle(mixed.withColumn("offset", F.coalesce(offset, F.lit(0)).cast("long")).drop("rank"), "mixed")

    used = mixed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    room = used.withColumn("room", ROOM - F.col("used")).filter("room > 0")
    wanted = room.agg(F.coalesce(F.sum("room"), F.lit(0))).first()[0]
    cut_whole = min(n_whole, -(-wanted // ROOM))
    last_room = cut_whole * ROOM - wanted  # of the last one cut; below 0: some room stays empty
    whole = settle(_ranked(whole, "size", n_whole), "whole")

    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kept = whole.filter(F.col("rank") >= cut_whole)
    kept = kept.withColumn("sequence_id", F.lit(n_mixed) + F.col("rank") - cut_whole).withColumn("offset", F.lit(0))
    after = n_mixed + n_whole - cut_whole

    gaps = _with_room(room, n_mixed)
    spans = F.sequence(F.floor(F.col("before") / ROOM), F.floor((F.col("before") + F.col("room") - 1) / ROOM))
    gaps = gaps.withColumn("rank", F.explode(spans)).filter(F.col("rank") < cut_whole)
    lo = F.greatest(F.col("before"), F.col("rank") * ROOM)
    hi = F.least(F.col("before") + F.col("room"), (F.col("rank") + 1) * ROOM)
    fill = gaps.select(
        "rank",
        "sequence_id",
        (lo - F.col("rank") * ROOM).alias("from"),
        (hi - lo).alias("length"),
        (F.col("used") + lo - F.col("before")).alias("offset"),
    )
    rest, at = [], ROOM - last_room
    for k in range(ROOM.bit_length()):
        if last_room > 0 and last_room >> k & 1:
            rest.append((cut_whole - 1, after + len(rest), at, 1 << k, 0))
            at += 1 << k
    tail = spark.createDataFrame(rest, "rank long, sequence_id long, from long, length long, offset long")
    sources = whole.filter(F.col("rank") < cut_whole).select("key", "text_hash", "rank", F.col("start").alias("first"))
    cuts = sources.join(fill.union(tail), "rank").withColumn("start", F.col("first") + F.col("from"))
    cuts = cuts.groupBy("key", "text_hash").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")))
    cuts = cuts.toDF("key", "text_hash", "cuts")  # at most the document's own tokens
    again = narrow.join(cuts, ["key", "text_hash"]).dropDuplicates(["key", "text_hash"])
    again = again.select("doc_id", text_col, "cuts")
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    filled = again.mapInArrow(_cut_again(path), kind)
    return mixed.select(*out).unionByName(kept.select(*out)).unionByName(filled)
