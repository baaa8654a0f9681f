"""Author similarity of the two records of a citation edge.

Both author lists sit in the edge's row after the join, so the product of the two lists
is never turned into rows and nothing is shuffled, grouped or joined back: the scores of
an edge are computed where the edge is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echocite.functions.editing import by_length, dl_block, jaro_winkler_block
from echocite.functions.names import plain_name

AUTHOR_THRESHOLD = 0.65  # fixed value: similarity from which two authors match

# A matching pair: positions in both lists, score, and score to 3 digits.
MATCH = T.StructType(
    [
        T.StructField("m", T.IntegerType()),
        T.StructField("c", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("shown", T.DoubleType()),
    ]
)

# Author pairs of a batch that are held at once, whatever the length of one list.
PAIR_BUDGET = 1 << 19


def _flat_column(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first index, length, values) of a list column; a NULL list is an empty one."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    return np.cumsum(sizes) - sizes, sizes, lists.flatten().fill_null("")


def _codes(*columns: pa.Array) -> tuple[list[np.ndarray], list[str]]:
    """Integer codes of several string columns over one vocabulary."""
    coded = pa.concat_arrays([c.cast(pa.string()) for c in columns]).dictionary_encode()
    numbers = np.asarray(coded.indices).astype(np.int64)
    return np.split(numbers, np.cumsum([len(c) for c in columns])[:-1]), coded.dictionary.to_pylist()


def _similar(block, symmetric: bool, names: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of coded names, each distinct unequal pair once."""
    value = np.ones(len(left))
    differ = np.flatnonzero(left != right)
    one, two = left[differ], right[differ]
    if symmetric:
        one, two = np.minimum(one, two), np.maximum(one, two)
    span = max(1, len(names))
    pairs, back = np.unique(one * span + two, return_inverse=True)
    value[differ] = by_length(block, names, pairs // span, pairs % span)[back]
    return value


def author_scores(threshold: float = AUTHOR_THRESHOLD, jaro_winkler: bool = False):
    """An Arrow UDF of (main names, main ids, citing names, citing ids).

    Two ids decide by equality; with one missing the normalised names are compared. The
    result has the best score by edit distance, on request the best by Jaro-Winkler
    (which uses the same id rule), and the pairs that reach `threshold` by the former,
    main author first. Scores are also given rounded half-even to 4 and 3 digits.
    """
    fields = ["dl", "dl4", "jw"] if jaro_winkler else ["dl", "dl4"]
    returns = T.StructType([T.StructField(f, T.DoubleType()) for f in fields]).add("matches", T.ArrayType(MATCH))

    @F.arrow_udf(returns)
    def score(main_names: pa.Array, main_ids: pa.Array, citing_names: pa.Array, citing_ids: pa.Array) -> pa.Array:
        n = len(main_names)
        main_at, main_size, main_name = _flat_column(main_names)
        citing_at, citing_size, citing_name = _flat_column(citing_names)
        (main_code, citing_code), raw = _codes(main_name, citing_name)
        (main_id, citing_id), ids = _codes(_flat_column(main_ids)[2], _flat_column(citing_ids)[2])
        no_id = ids.index("") if "" in ids else -1

        # Raw names to normalised ones, as codes again: normalised once per distinct name.
        plain = pa.array([plain_name(s) for s in raw], pa.string()).dictionary_encode()
        to_plain, names = np.asarray(plain.indices).astype(np.int64), plain.dictionary.to_pylist()
        main_code, citing_code = to_plain[main_code], to_plain[citing_code]

        ends = np.cumsum(main_size.astype(np.int64) * citing_size)
        best = {"dl": np.zeros(n), "jw": np.zeros(n)}
        kept = []
        for low in range(0, int(ends[-1]) if n else 0, PAIR_BUDGET):
            pair = np.arange(low, min(low + PAIR_BUDGET, int(ends[-1])))
            row = np.searchsorted(ends, pair, side="right")
            within = pair - (ends[row] - main_size[row].astype(np.int64) * citing_size[row])
            m, c = np.divmod(within, citing_size[row])
            i, j = main_at[row] + m, citing_at[row] + c
            both = (main_id[i] != no_id) & (citing_id[j] != no_id)
            by_id = (main_id[i] == citing_id[j]).astype(np.float64)
            by_name = np.flatnonzero(~both)
            left, right = main_code[i[by_name]], citing_code[j[by_name]]
            value = by_id.copy()
            value[by_name] = _similar(dl_block, True, names, left, right)
            np.maximum.at(best["dl"], row, value)
            if jaro_winkler:
                other = by_id
                other[by_name] = _similar(jaro_winkler_block, False, names, left, right)
                np.maximum.at(best["jw"], row, other)
            hit = np.flatnonzero(value >= threshold)
            kept.append((row[hit], m[hit], c[hit], value[hit]))

        rows, m, c, value = (np.concatenate(part) for part in zip(*kept)) if kept else (np.zeros(0, int),) * 4
        starts = np.searchsorted(rows, np.arange(n + 1))
        pairs = pa.StructArray.from_arrays(
            [
                pa.array(m, pa.int32()),
                pa.array(c, pa.int32()),
                pa.array(value, pa.float64()),
                pa.array([round(v, 3) for v in value.tolist()], pa.float64()),
            ],
            names=["m", "c", "score", "shown"],
        )
        columns = [pa.array(best["dl"]), pa.array([round(v, 4) for v in best["dl"].tolist()], pa.float64())]
        if jaro_winkler:
            columns.append(pa.array(best["jw"]))
        columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs))
        return pa.StructArray.from_arrays(columns, names=[*fields, "matches"])

    return score


def compare(udf, main_authors: Column, citing_authors: Column, unless: Column | None = None) -> Column:
    """Apply an `author_scores` UDF; rows where `unless` holds send it empty lists."""
    arguments = [main_authors["name"], main_authors["id"], citing_authors["name"], citing_authors["id"]]
    if unless is not None:
        arguments = [F.when(~unless, a) for a in arguments]
    return udf(*arguments)


def match_texts(matches: Column, main_authors: Column, citing_authors: Column) -> Column:
    """`A <-> B (score: s, method: ID|DL)` for each matching pair, main author first."""

    def text(pair: Column) -> Column:
        a, b = F.get(main_authors, pair["m"]), F.get(citing_authors, pair["c"])
        method = F.when((a["id"] != "") & (b["id"] != ""), "ID").otherwise("DL")
        shown = pair["shown"].cast("string")
        return F.concat(a["name"], F.lit(" <-> "), b["name"], F.lit(" (score: "), shown, F.lit(", method: "), method, F.lit(")"))

    return F.transform(matches, text)
