"""Edit distance with adjacent transpositions, Jaro and Jaro-Winkler, by batch.

Spark's `levenshtein` counts a swap of neighbours as two edits, and it has no Jaro, so
these two run as Arrow UDFs. Each works on many string pairs at once: strings become
rows of a code-point matrix and every step is one numpy operation over all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echocite.functions.names import plain_name

PREFIX_WEIGHT = 0.1  # fixed value: weight of one common leading character
PREFIX_MAX = 4  # fixed value: leading characters that count

# Matrix cells one step may hold; longer strings are taken in smaller slices.
CELL_BUDGET = 1 << 18


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, width) code points, zero-padded, and the n lengths."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    width = max(1, int(lengths.max(initial=0)))
    codes = np.array(strings, dtype=f"U{width}").view(np.uint32).reshape(len(strings), width)
    narrow = np.uint16 if codes.max(initial=0) < 1 << 16 else np.uint32
    return codes.astype(narrow), lengths


WORD = 64


def _carried(x: np.ndarray) -> np.ndarray:
    """Numbers of several words, lowest first, shifted up by one bit."""
    up = x << np.uint64(1)
    up[1:] |= x[:-1] >> np.uint64(WORD - 1)
    return up


def _sum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of numbers of several words, modulo the words' length."""
    total = x + y
    if len(x) > 1:
        carry = total < x
        for k in range(1, len(x)):
            total[k] += carry[k - 1]
            carry[k] |= (total[k] == 0) & carry[k - 1]
    return total


def osa_block(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Restricted (no edit inside a swapped pair) edit distance of row pairs, a bit for each row of the table.

    The table's next column follows from the differences between neighbouring cells of the last one, which are -1, 0 or
    1 and so two bit vectors, by a fixed number of operations on words: Myers's method with Hyyrö's term for swaps.
    Longer strings take several words, whose carries and shifts are handed on. The distance is followed at the
    bit of each string's own length; bits beyond it have no part in that.
    """
    if a.shape[1] < b.shape[1]:
        a, la, b, lb = b, lb, a, la
    n, words = len(a), -(-a.shape[1] // WORD)
    matches = np.zeros((n, words * WORD // 8), np.uint8)
    used = -(-a.shape[1] // 8)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    same, before = np.zeros((words, n), np.uint64), np.zeros((words, n), np.uint64)
    last, shift = np.maximum(la - 1, 0) // WORD, (np.maximum(la - 1, 0) % WORD).astype(np.uint64)
    rows, one = np.arange(n), np.uint64(1)
    distance = la.astype(np.int32)
    for j in range(b.shape[1]):
        matches[:, :used] = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little")
        equal = matches.view("<u8").T.copy()
        swapped = _carried(~same & equal) & before
        same = (_sum(equal & up, up) ^ up) | equal | down | swapped
        plus, minus = down | ~(same | up), same & up
        at_end = [(x[last, rows] >> shift & one).astype(np.int32) for x in (plus, minus)]
        distance += np.where(j < lb, at_end[0] - at_end[1], 0)
        plus, minus = _carried(plus), _carried(minus)
        plus[0] |= one
        up, down, before = minus | ~(same | plus), plus & same, equal
    return np.where(la == 0, lb, distance).astype(np.int32)


def jaro_block(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Jaro similarity of row pairs, matching greedily from the left."""
    n, wa = a.shape
    wb = b.shape[1]
    everyone, cols = np.arange(n), np.arange(wb)
    reach = (np.maximum(la, lb) // 2 - 1)[:, None]
    free = cols < lb[:, None]
    hit = np.zeros((n, wa), dtype=bool)
    taken = np.zeros((n, wb), dtype=bool)
    for i in range(wa):
        options = (b == a[:, i : i + 1]) & free & (np.abs(cols - i) <= reach) & (la > i)[:, None]
        first = options.argmax(axis=1)
        found = options[everyone, first]
        hit[:, i] = found
        taken[everyone[found], first[found]] = True
        free[everyone[found], first[found]] = False
    matched = hit.sum(axis=1)
    # Matched characters of both sides, moved to the front in their own order.
    left = np.take_along_axis(a, np.argsort(~hit, axis=1, kind="stable"), axis=1)
    right = np.take_along_axis(b, np.argsort(~taken, axis=1, kind="stable"), axis=1)
    width = min(wa, wb)
    off = (left[:, :width] != right[:, :width]) & (np.arange(width) < matched[:, None])
    out_of_order = off.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (matched / la + matched / lb + (matched - out_of_order / 2) / matched) / 3
    score = np.where(matched == 0, 0.0, score)
    same = (la == lb) & (_common_prefix(a, la, b, lb, max(wa, wb)) == la)
    return np.where(same, 1.0, score)


def _common_prefix(a, la, b, lb, limit: int) -> np.ndarray:
    width = min(a.shape[1], b.shape[1], limit)
    inside = np.arange(width) < np.minimum(la, lb)[:, None]
    agree = (a[:, :width] == b[:, :width]) & inside
    return np.minimum.accumulate(agree, axis=1).sum(axis=1)


def jaro_winkler_by(weight: float = PREFIX_WEIGHT):
    """Jaro plus the bonus for a common prefix, which applies at every Jaro value."""

    def block(a, la, b, lb) -> np.ndarray:
        jaro = jaro_block(a, la, b, lb)
        return jaro + _common_prefix(a, la, b, lb, PREFIX_MAX) * weight * (1 - jaro)

    return block


jaro_winkler_block = jaro_winkler_by()


def dl_block(a, la, b, lb) -> np.ndarray:
    """1 - distance / longer length; two empty strings are equal."""
    longer = np.maximum(la, lb)
    distance = osa_block(a, la, b, lb)
    return np.where(longer == 0, 1.0, 1.0 - distance / np.maximum(longer, 1))


Block = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def by_length(block: Block, vocabulary: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """`block` over vocabulary[left[k]], vocabulary[right[k]].

    Pairs are taken in order of their longer string, in slices of bounded size, so one
    long string does not widen the matrix of all the others.
    """
    lengths = np.array([len(s) for s in vocabulary], dtype=np.int64)
    longer = np.maximum(lengths[left], lengths[right])
    order = np.argsort(longer, kind="stable")
    result = np.zeros(len(left), dtype=np.float64)
    start = 0
    while start < len(order):
        width = max(1, int(longer[order[start]]))
        stop = min(len(order), start + max(1, CELL_BUDGET // (2 * width)))
        stop = start + int(np.searchsorted(longer[order[start:stop]], 2 * width, side="right"))
        part = order[start:stop]
        names, local = np.unique(np.concatenate([left[part], right[part]]), return_inverse=True)
        codes, size = code_points([vocabulary[k] for k in names])
        one, two = local[: len(part)], local[len(part) :]
        result[part] = block(codes[one], size[one], codes[two], size[two])
        start = stop
    return result


def pair_column(block: Block, returns: T.DataType, prepare: Callable[[str], str] | None = None):
    """An Arrow UDF of two string columns that scores each distinct pair of a batch once."""
    to_arrow = pa.int32() if returns == T.IntegerType() else pa.float64()

    @F.arrow_udf(returns)
    def score(first: pa.Array, second: pa.Array) -> pa.Array:
        both = pa.concat_arrays([first.cast(pa.string()), second.cast(pa.string())])
        coded = both.dictionary_encode()
        vocabulary = [prepare(s) if prepare else s for s in coded.dictionary.to_pylist()]
        known = np.asarray(both.is_valid())
        rows = np.flatnonzero(known[: len(first)] & known[len(first) :])
        codes = np.asarray(coded.indices.fill_null(0))
        left, right = codes[: len(first)][rows], codes[len(first) :][rows]
        span = max(1, len(vocabulary))
        pairs, back = np.unique(left.astype(np.int64) * span + right, return_inverse=True)
        values = np.zeros(len(first), dtype=np.float64)
        values[rows] = by_length(block, vocabulary, pairs // span, pairs % span)[back]
        missing = np.ones(len(first), dtype=bool)
        missing[rows] = False
        return pa.array(values, mask=missing).cast(to_arrow)

    return score


osa_distance = pair_column(osa_block, T.IntegerType())
dl_similarity = pair_column(dl_block, T.DoubleType())
jaro_similarity = pair_column(jaro_block, T.DoubleType())
jaro_winkler_similarity = pair_column(jaro_winkler_block, T.DoubleType())
name_dl = pair_column(dl_block, T.DoubleType(), plain_name)
name_jaro_winkler = pair_column(jaro_winkler_block, T.DoubleType(), plain_name)
