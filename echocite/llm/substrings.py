"""Deletion of passages that repeat, by content-defined chunks.

A gear hash rolls over each text's bytes; where a word starts and the hash is low enough a chunk ends, so an insertion
moves only the chunks around it. Within words chunks end only where a word is longer than words are. Chunks are compared by digest. The first place of a digest, by id and position, is
kept; later places that follow each other make runs, and runs of enough bytes are the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocite.llm.common import fresh, row_key, small_batches, utf8
from echocite.session import settle

REACH = 32  # bytes that the gear hash looks back on
MIN_CHUNK = 20  # bytes
MAX_CHUNK = 512
MIN_RUN = 80  # bytes of chunks next to each other that make a passage
AT_WORD = np.uint32((1 << 32) // 3)  # a word start ends a chunk if the hash is below this
IN_WORD = np.uint32((1 << 32) // 400)  # and another letter if it is below this and
LONG_WORD = 64  # bytes lie since the last blank, as in texts without blanks
PLACE = 1024  # a chunk's place is its first byte times this, plus its length

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _gears() -> np.ndarray:
    """One fixed 32-bit number for each byte, from a hash of the byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


_GEAR = _gears()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 32 bytes' gears, each shifted by its distance, by doubling the reach."""
    h = _GEAR[data]
    reach = 1
    while reach < REACH:
        shifted = np.zeros_like(h)
        shifted[reach:] = h[:-reach] << np.uint32(reach)
        h = h + shifted
        reach *= 2
    return h


def cuts(text: bytes) -> list[int]:
    """Where chunks start, and the text's end. Chunks have 20 to 512 bytes, but for the last and letters at an end.
    They start where words do, but for the first, those after a chunk of 512 bytes and those in words of over 64."""
    size = len(text)
    if not size:
        return [0]
    data = np.frombuffer(text, np.uint8)
    h, blank = gear_hashes(data)[:-1], _BLANK[data]
    start = blank[:-1] & ~blank[1:]
    inside = np.flatnonzero((h < IN_WORD) & ((data[1:] & 0xC0) != 0x80))
    blanks = np.concatenate([[-1], np.flatnonzero(blank)])
    inside = inside[inside - blanks[np.searchsorted(blanks, inside, "right") - 1] >= LONG_WORD]
    found = (np.union1d(np.flatnonzero(start & (h < AT_WORD)), inside) + 1).tolist()
    out, last = [0], 0
    for at in [*found, size]:
        while at - last > MAX_CHUNK:
            cut = last + MAX_CHUNK
            while (data[cut] & 0xC0) == 0x80:
                cut -= 1
            out.append(cut)
            last = cut
        if at - last >= MIN_CHUNK or at == size:
            out.append(at)
            last = at
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, key, text_hash, place) of every chunk."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        digests: list[int] = []
        places, counts = [], []
        for text in utf8(batch.column(2)):
            at = cuts(text)
            digests.extend([digest(text[a:b]) for a, b in zip(at, at[1:])])
            at = np.array(at, np.int64)
            places.append(at[:-1] * PLACE + np.diff(at))
            counts.append(len(at) - 1)
        own = [np.repeat(batch.column(k).to_numpy(zero_copy_only=False), counts) for k in range(2)]
        held = [np.array(digests, np.uint64).view(np.int64), *own, np.concatenate(places) if places else np.zeros(0, int)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], ["digest", "key", "text_hash", "place"])


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, key, text_hash, place) for every chunk of every row."""
    small_batches(docs.sparkSession)
    narrow = docs.select(row_key(id_col, text_col).alias("key"), F.xxhash64(text_col).alias("text_hash"), text_col)
    return narrow.mapInArrow(_chunks, "digest long, key long, text_hash long, place long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated chunks of one document: neighbours joined, short ones left out."""
    names = ["key", "text_hash", "start", "length", "source"]
    for batch in batches:
        rows: list[tuple] = []
        for key, text_hash, own in zip(*[c.to_pylist() for c in batch.columns]):
            found = sorted({(c["place"] // PLACE, c["place"] % PLACE, c["source"]) for c in own})
            run: list[int] = []
            for start, length, source in [*found, (-1, 0, 0)]:
                if run and start == run[0] + run[1]:
                    run[1] += length
                    if length > run[3]:
                        run[2:] = [source, length]
                    continue
                if run and run[1] >= MIN_RUN:
                    rows.append((key, text_hash, *run[:3]))
                run = [start, length, source, length]
        columns = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text_hash, start, length, source): every later copy of a passage, in bytes of the UTF-8 text.

    source is the key of the row where the longest chunk of the passage is found first; that may be the row itself.
    Rows with the same id and text are one document, and of rows with the same id and other texts the one whose text
    has the least hash comes first. Rows without id come last. Missing and empty texts have no passages.
    """
    pieces = chunks(docs, id_col, text_col)
    place = F.struct("key", "text_hash", "place")
    firsts = pieces.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Written, so that the join reads both sides from shuffles and a digest with very many places can be split.
    firsts = settle(firsts.filter("first != last").select("digest", "first"), "first-chunks")
    later = pieces.join(firsts, "digest").filter(place != F.col("first"))
    chunk = F.struct("place", F.col("first.key").alias("source"))
    # No more than a document's own chunks; a chunk's row is a fraction of its text.
    listed = later.groupBy("key", "text_hash").agg(F.collect_list(chunk).alias("chunks"))
    return listed.mapInArrow(_runs, "key long, text_hash long, start long, length long, source long")


def without(text: str | None, spans) -> str | None:
    """The text without spans of its UTF-8 bytes, which start and end at letters and don't overlap."""
    if text is None or spans is None or not len(spans):
        return text
    data, at, parts = text.encode(), 0, []
    for span in sorted(spans, key=lambda s: s["start"]):
        parts.append(data[at : span["start"]])
        at = span["start"] + span["length"]
    return b"".join([*parts, data[at:]]).decode()


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with later copies of passages deleted from the texts; a row of which nothing is left is dropped."""
    small_batches(docs.sparkSession)
    found = repeated_passages(docs, id_col, text_col)
    names = {n: fresh(docs, n) for n in ("row_key", "text_hash", "spans", "kept_text")}
    spans = found.groupBy("key", "text_hash").agg(F.collect_list(F.struct("start", "length")))
    spans = spans.toDF(names["row_key"], names["text_hash"], names["spans"])
    keyed = docs.withColumn(names["row_key"], row_key(id_col, text_col))
    keyed = keyed.withColumn(names["text_hash"], F.xxhash64(text_col))
    joined = keyed.join(spans, [names["row_key"], names["text_hash"]], "left")

    @F.pandas_udf("string")
    def kept(texts: pd.Series, cut: pd.Series) -> pd.Series:
        return pd.Series([without(t, s) for t, s in zip(texts, cut)], dtype=object)

    left = F.col(names["spans"]).isNull() | (F.btrim(names["kept_text"], F.lit(" \t\n\x0b\x0c\r")) != "")
    text = F.when(F.col(names["spans"]).isNull(), F.col(text_col)).otherwise(F.col(names["kept_text"]))
    out = joined.withColumn(names["kept_text"], kept(F.col(text_col), F.col(names["spans"]))).filter(left)
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
