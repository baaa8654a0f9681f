"""Near-duplicate documents by 64-bit SimHash, linked by ball hashing that meets in the middle.

Two fingerprints within 3 bits meet at a variant that is at most 1 flip from one and 2 flips from the other. Every
fingerprint emits its variants within one flip. Variants with two flips are needed only for a distance of exactly 3,
where one fingerprint has an even and the other an odd number of ones, so the even ones emit them; and of any three
positions two lie in the same half of the word, so pairs within a half are enough. Rows are shuffled on the variant:
on the half that two flips leave alone, so those of one fingerprint lie together and compress well. Variants of at most
one flip go by either half, and one side of every link is such a variant, so they meet in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocite.llm.common import fresh, merged, row_key, small_batches, tasks_for, utf8
from echocite.llm.components import LINK_SCHEMA, components, spanning_links
from echocite.session import settle

RADIUS = 3  # the variants below are made for this distance
SHINGLE = 3
SEED = 42
BLOCK = 65536  # shingles whose bits are counted at a time
VARIANTS_PER_TASK = 300_000
VARIANT = ["place", "variant", "bits"]

_FLIPS_1 = np.array([0, *(1 << i for i in range(64))], np.uint64)
_FLIPS_2 = [np.array([1 << i | 1 << j for i, j in combinations(range(h, h + 32), 2)], np.uint64) for h in (0, 32)]
_ODD = [_FLIPS_1, _FLIPS_1]  # to be shuffled on the upper half, and on the lower one
_EVEN = [np.concatenate([_FLIPS_1, two]) for two in _FLIPS_2]
_ROWS = sum(map(len, _ODD + _EVEN)) / 2  # that a fingerprint emits on average


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), BLOCK):
        spans = zip(starts[at : at + BLOCK], ends[at : at + BLOCK])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(ends), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([simhash(t) for t in utf8(batch.column(3))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values)], ["key", "text_hash", "id", "bits"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, variant, bits). The place is a half of the variant and, to part large groups, parities of the other."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            held = batch.column(0).slice(at, 256).to_numpy(zero_copy_only=False).view(np.uint64)
            even = np.bitwise_count(held) % 2 == 0
            for own, sides in ((held[even], _EVEN), (held[~even], _ODD)):
                for side, flips in enumerate(sides if len(own) else []):
                    made = (own[:, None] ^ flips[None, :]).ravel()
                    halves = made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)
                    other = halves[1 - side].copy()
                    for shift in (16, 8, 4):
                        other ^= other >> np.uint64(shift)
                    place = halves[side] << np.uint64(5) | np.uint64(side << 4) | other & np.uint64(15)
                    columns = (place, made, np.repeat(own, len(flips)))
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], VARIANT)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition of variants. Whoever reaches a variant by 1 flip is within 3 bits of all that reach
    it by 2, so a star around the smallest such fingerprint has the meeting's links in linear space; fingerprints
    that are 2 flips away on both sides differ by 2 or 4 bits, and at 2 bits they meet at another variant."""
    table = merged(batches)
    if table is None:
        return
    variant, bits = (table.column(k).to_numpy().view(np.uint64) for k in range(2))
    del table
    order = np.argsort(variant, kind="stable")
    variant, bits = variant[order], bits[order]
    del order
    same = variant[1:] == variant[:-1]
    met = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    variant, bits = variant[met], bits[met]
    if not len(variant):
        return
    group = np.concatenate([[0], np.cumsum(variant[1:] != variant[:-1])])
    near = np.bitwise_count(variant ^ bits) <= 1
    centre = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(centre, group[near], bits[near].view(np.int64))
    centre = centre[group].view(np.uint64)
    linked = (bits != centre) & (np.bitwise_count(bits ^ centre) <= RADIUS)
    pairs = np.unique(np.stack([bits[linked], centre[linked]], axis=1), axis=0).view(np.int64)
    nodes, roots = spanning_links(pairs[:, 0].tolist(), pairs[:, 1].tolist())
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], schema=LINK_SCHEMA)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text_hash, id, bits) of every row; a text that is missing or has no words has the fingerprint 0."""
    small_batches(docs.sparkSession)
    key, given = row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id")
    narrow = docs.select(key, F.xxhash64(text_col).alias("text_hash"), given, text_col)
    return narrow.mapInArrow(_fingerprints, "key long, text_hash long, id long, bits long")


def linked_fingerprints(distinct: DataFrame) -> DataFrame:
    """(a, b) links that connect all fingerprints (column bits, distinct, settled) within 3 bits of each other."""
    tasks = tasks_for(distinct.count() * _ROWS, VARIANTS_PER_TASK, distinct.sparkSession)
    kind = ", ".join(f"{c} long" for c in VARIANT)
    made = distinct.select("bits").repartition(tasks, "bits").mapInArrow(_variants, kind)
    dealt = made.repartition(tasks, "place").select("variant", "bits")
    return dealt.mapInArrow(_meetings, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The settled fingerprints of all rows, and (bits, root, id, first) for every distinct one: its component, the
    smallest id with it, and the smallest (key, text_hash). Equal fingerprints are one node, however many rows share them."""
    marked = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    first = F.min(F.struct("key", "text_hash")).alias("first")
    classes = settle(marked.groupBy("bits").agg(F.min("id").alias("id"), first), "fingerprint-classes")
    roots = components(linked_fingerprints(classes)).withColumnRenamed("node", "bits")
    return marked, classes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, fingerprint, component_id, component_key) of every row, repeated rows included.

    component_id is the smallest id in the component, NULL where no member has one; component_key is the smallest
    row key (an id, or a stand-in for a missing one). Nothing in it depends on other columns. An empty table gives an
    empty result.
    """
    marked, classes = _grouped(docs, id_col, text_col)
    lowest = classes.groupBy("root").agg(F.min("id").alias("component_id"), F.min("first.key").alias("component_key"))
    named = classes.select("bits", "root").join(lowest, "root").drop("root")
    hexed = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return marked.join(named, "bits").select("key", "id", hexed.alias("fingerprint"), "component_id", "component_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component of `near_duplicates`: that with the smallest id, and of rows with that id the
    one whose text has the least hash; rows without id come last. Of rows with the same id and text one stays."""
    _, classes = _grouped(docs, id_col, text_col)
    stays = classes.groupBy("root").agg(F.min("first").alias("first")).select("first.key", "first.text_hash")
    names = [fresh(docs, n) for n in ("row_key", "text_hash")]
    keyed = docs.withColumns(dict(zip(names, (row_key(id_col, text_col), F.xxhash64(text_col)))))
    held = keyed.join(stays.toDF(*names), names, "left_semi")
    return held.dropDuplicates(names).select(*docs.columns)
