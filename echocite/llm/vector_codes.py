"""Compression of vectors to short codes by exact integer arithmetic.

Components become whole numbers and vectors are cut into parts; a part's code is the nearest entry of its position's
codebook. Distances are |x|^2 - 2 x.c + |c|^2, with the products made by floating-point matrix multiplication that is
exact all the same: numbers are broken into limbs of so few bits that every sum of products of two limbs stays below
2^53, and the limbs' products are put together as 64-bit integers. So the first of the least distances is the same
wherever a row is computed, and whatever rows share its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocite.llm.common import fresh
from echocite.session import settle

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
MANTISSA = 53
BLOCK = 4096  # vectors whose distances are held at a time


def limb_bits(terms: int) -> int:
    """Bits of a limb, so that a sum of `terms` products of two of them stays below 2^53."""
    return (MANTISSA - (terms - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Whole numbers as limbs, lowest first: x = sum of limb k times 2^(k bits). The last limb bears the sign."""
    held, rest = [], x
    while rest.size and (rest.max() >= 1 << bits or rest.min() < -(1 << bits)):
        held.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*held, rest.astype(np.float64)]


def dot_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x times the transpose of c, both of 64-bit integers, exactly modulo 2^64."""
    if not x.shape[1]:
        return np.zeros((len(x), len(c)), np.int64)
    bits = limb_bits(x.shape[1])
    out = np.zeros((len(x), len(c)), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(c, bits)):
            if bits * (i + j) < 64:
                out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest row of c for each row of x, and the squared distance."""
    found, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    own = (c * c).sum(axis=1)
    for at in range(0, len(x), BLOCK):
        piece = x[at : at + BLOCK]
        d = (piece * piece).sum(axis=1)[:, None] - 2 * dot_products(piece, c) + own
        found[at : at + BLOCK] = d.argmin(axis=1)
        least[at : at + BLOCK] = d.min(axis=1)
    return found, least


def whole(vectors: pa.Array, length: int, parts: int = PARTS, scale: int = SCALE) -> np.ndarray:
    """Vectors without missing components as integers, (rows, parts, components of a part)."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    limit = 2.0 ** ((61 - max(length - 1, 1).bit_length()) // 2)  # beyond it a sum of squares may not fit 64 bits
    if flat.size and np.abs(flat).max() >= limit:
        raise ValueError(f"components must stay within {limit / scale:g}, so that errors fit into 64 bits")
    return flat.astype(np.int64).reshape(len(vectors), parts, length // parts)


def _sums(books: np.ndarray, length: int):
    """(part, entry, at, total, n) for one task: sums of the components that each entry is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, size = books.shape
        totals, counts = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = whole(batch.column(0), length, parts)
            for p in range(parts):
                code, _ = nearest(x[:, p], books[p])
                np.add.at(totals[p], code, x[:, p])
                counts[p] += np.bincount(code, minlength=entries)
        p, e, a = (k.ravel() for k in np.indices(totals.shape))
        used = counts[p, e] > 0
        columns = [k[used] for k in (p, e, a, totals.ravel(), counts[p, e])]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in columns], ["part", "entry", "at", "total", "n"])

    return run


def _refined(vectors: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    """Codebooks with every used entry replaced by its parts' floored mean."""
    rows = vectors.mapInArrow(_sums(books, length), "part long, entry long, at long, total long, n long")
    sums = rows.groupBy("part", "entry", "at").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )
    out = books.copy()
    for r in sums.collect():  # no more rows than the codebooks have numbers
        out[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return out


def _coded(books: np.ndarray, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column(2), length, books.shape[0])
            codes, error = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), np.int64)
            for p in range(books.shape[0]):
                found, least = nearest(x[:, p], books[p])
                codes[:, p] = found
                error += least
            texts = pa.array([row.tobytes().hex() for row in codes], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], texts, pa.array(error)], ["id", "label", "code", "error"])

    return run


def kept_vectors(vectors: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector is there and holds finite numbers only."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(vector_col).isNotNull() & ~bad)


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) from all kept rows; without any, no entries.

    They start as the parts of the vectors with the smallest ids (missing ids last, equal ids by their vectors).
    All kept vectors must have one length that the number of parts divides.
    """
    kept = kept_vectors(vectors, vector_col)
    lengths = kept.agg(F.min(F.size(vector_col)), F.max(F.size(vector_col))).first()
    if lengths[0] is None:
        return np.zeros((PARTS, 0, 0), np.int64)
    if lengths[0] != lengths[1] or lengths[0] % PARTS:
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}; found {lengths[0]} to {lengths[1]}")
    length = lengths[0]
    first = kept.orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(ENTRIES).select(vector_col).toArrow()
    books = whole(first.column(0).combine_chunks(), length).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _refined(kept.select(vector_col), books, length)
    return books


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal numbers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(
    vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(id, label, code, error) of every kept row: entry numbers in part order as two hexadecimal digits each, and
    the squared distances summed over parts."""
    kept = kept_vectors(vectors, vector_col).select(id_col, label_col, vector_col)
    kind = kept.schema[label_col].dataType.simpleString()
    length = books.shape[0] * books.shape[2]
    named = kept.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector_col)
    return named.mapInArrow(_coded(books, length), f"id long, label {kind}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code", scale: int = SCALE) -> DataFrame:
    """`codes` with the vectors that they stand for, within half a step of the codebooks' whole numbers."""
    name = fresh(codes, "decoded")

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = np.arange(books.shape[0])
            yield texts.map(lambda t: ((books[parts, list(bytes.fromhex(t))] + 0.5) / scale).ravel())

    return codes.withColumn(name, vectors(F.col(code_col)))


def code_errors(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row.

    label_error is the error summed over the rows with the same label, missing ones together. Repeated rows count and
    are returned as often as they are there. A table without kept rows gives an empty result.
    """
    books = train(vectors)
    coded = settle(encode(vectors, books), "vector-codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.select(F.col("label").alias("own"), "label_error")
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("own")))
    digest = F.lit(books_digest(books)).alias("codebooks_sha256")
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest)


def _assigned(books: str) -> str:
    """SQL: every part with the first of its nearest entries and the squared distance."""
    return f"""(
    select vec_id, vec, label, part, xs, entry, d from (
        select p.*, b.entry, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.xs, b.cs)]) as d,
            row_number() over (partition by p.vec, p.part order by d, b.entry) as place
        from parts p join {books} b using (part)
    ) where place = 1)"""


def _refined_sql(books: str, used: str) -> str:
    return f"""(
    select part, entry, coalesce(means, cs) as cs from {books} left join (
        select part, entry, list(floor_mean order by pos) as means from (
            select part, entry, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as floor_mean
            from (select part, entry, unnest(xs) as x, generate_subscripts(xs, 1) as pos from {used})
            group by part, entry, pos)
        group by part, entry) using (part, entry))"""


ORACLE = f"""
with kept as (
    select vec_id, label, row_number() over (order by vec_id nulls last, embedding) as vec,
        [floor({SCALE} * x::double)::bigint for x in embedding] as xs
    from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), parts as (
    select vec_id, label, vec, part, xs[part * (len(xs) // {PARTS}) + 1 : (part + 1) * (len(xs) // {PARTS})] as xs
    from kept, range({PARTS}) r(part)
), books0 as (select part, vec - 1 as entry, xs as cs from parts where vec <= {ENTRIES}),
used0 as {_assigned("books0")},
books1 as {_refined_sql("books0", "used0")},
used1 as {_assigned("books1")},
books2 as {_refined_sql("books1", "used1")},
used2 as {_assigned("books2")},
coded as (
    select vec, any_value(vec_id) as vec_id, any_value(label) as label,
        string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error
    from used2 group by vec
), books as (
    select sha256(string_agg(array_to_string(cs, ','), ',' order by part, entry)) as digest from books2
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
    digest as codebooks_sha256
from coded, books
"""
