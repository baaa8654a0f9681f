"""Labelled rows for training: a documented, bounded sample, and the fold that is never learned from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 20_000  # labelled rows learned from at most, the first by a hash of their id
FOLDS = 5


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. NULL for a missing id."""
    return F.crc32(F.col(id_col).cast("long").cast("string")) % FOLDS


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def training_sample(labels: DataFrame, label: str, rows: int = MAX_TRAIN, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label, part) for at most `rows` labelled ids outside fold 0, small enough to broadcast.

    An id labelled more than once counts once, with its greatest label; labels other than 0 and 1 and missing ids are
    left out. part is 0 to 3, by the same hash, for steps that must not see the same rows.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter((fold("doc_id") != 0) & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    slot = F.shiftright(order, 52)  # ascends with the hash, 4096 values
    held, last = 0, None
    for r in known.groupBy(slot.alias("slot")).count().orderBy("slot").collect():
        if held + r["count"] > rows:
            last = r["slot"]
            break
        held += r["count"]
    if last is not None:
        rest = known.filter(slot == last).orderBy(order, "doc_id").limit(rows - held)
        known = known.filter(slot < last).unionAll(rest)
    return known.withColumn("part", F.pmod(order, F.lit(4)).cast("int"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model by Newton steps; the last column of `x` may be a constant."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
