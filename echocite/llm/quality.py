"""Document quality by Bradley-Terry ranking: scores learnt from preference pairs, cut at a quantile of all scores.

A document's strength is a weighted sum of features of its text. In a pair of a good and a poor labelled document the
good one is preferred with a probability of 1 / (1 + e^-(difference of strengths)); the logistic loss on feature
differences gives the weights. The cut is the strength below which lies a given share of all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocite.llm.common import small_batches, strings
from echocite.llm.labelled import MAX_TRAIN, fit_logistic, held_out, training_sample
from echocite.session import settle

PAIRS_PER_POOR = 24  # good documents that each poor one of the sample is compared with
THRESHOLD = 0.3
PIECE = 60  # words of a stretch that is also looked at by itself

_MARKS = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_ENDS = re.compile(r"[.!?…][\"')\]]*$")
_REPEATED_MARK = re.compile(r"([^\w\s])\1")
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")

FEATURES = (
    "upper marks digits bars bangs odd_ends long_words mean_length short_share distinct top_word repeats pair_repeats "
    "distinct_lines log_words log_lines words_per_line sentence_words stops commas entropy case_mixed "
    "piece_upper piece_marks piece_repeats piece_distinct piece_bars doubled none"
).split()


def _of_words(words: list[str]) -> tuple[float, float, float, float]:
    """Shares of upper-case words, words with marks, repeats of the word before, and distinct words."""
    n = max(len(words), 1)
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n
    marks = sum(bool(_MARKS.search(w)) for w in words) / n
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    return upper, marks, repeats, len(set(words)) / n


def features(text: str) -> list[float]:
    """Numbers of a text that don't depend on its language; those of an empty text are 0 but for the last."""
    words = text.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    n, chars = len(words), max(len(text), 1)
    upper, marks, repeats, distinct = _of_words(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), float, n)
    shares = np.fromiter(counts.values(), float) / n
    pairs = Counter(zip(words, words[1:]))
    pieces = [_of_words(words[k : k + PIECE]) for k in range(0, n, PIECE) if n - k >= PIECE // 3 or k == 0]
    sentences = len(_SENTENCE.findall(text))
    log_n = math.log(n + 1)
    return [
        upper,
        marks,
        sum(c.isdigit() for c in text) / chars,
        text.count("|") / n,
        text.count("!") / n,
        sum(bool(_REPEATED_MARK.search(w)) for w in counts) / len(counts),
        float((lengths > 20).mean()),
        float(lengths.mean()) / 10,
        float((lengths <= 3).mean()),
        distinct * log_n / 5,
        float(shares.max()),
        repeats,
        sum(v for v in pairs.values() if v > 1) / n,
        len(set(lines)) / max(len(lines), 1),
        log_n / 5,
        math.log(len(lines) + 1) / 3,
        min(n / max(len(lines), 1), 100) / 50,
        min(n / max(sentences, 1), 60) / 30,
        sum(bool(_ENDS.search(w)) for w in words) / n,
        text.count(",") / n,
        float(-(shares * np.log(shares)).sum()) / max(log_n, 1.0),
        sum(w[1:] != w[1:].lower() and not w.isupper() for w in counts) / len(counts),
        max(p[0] for p in pieces),
        max(p[1] for p in pieces),
        max(p[2] for p in pieces),
        min(p[3] for p in pieces),
        max((x.count("|") / (len(x.split()) + 1) for x in lines), default=0.0),
        len(_REPEATED_MARK.findall(text)) / n,
        0.0,
    ]


@dataclass(frozen=True)
class Model:
    """Weights on standardised features, the share of documents below the cut, and the curve's steepness."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float
    slope: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float64())
    for batch in batches:
        held = pa.array([features(t) for t in strings(batch.column(1))], kind)
        yield pa.RecordBatch.from_arrays([*batch.columns[:1], batch.column(2), held], ["doc_id", "label", "x"])


def fit_pairs(differences: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights that minimise the logistic loss of (better minus worse) rows, by damped Newton steps."""
    w = np.zeros(differences.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -(differences @ v)).sum() + ridge * v @ v / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
        hessian = (differences * (p * (1 - p))[:, None]).T @ differences + ridge * np.eye(len(w))
        step, size = np.linalg.solve(hessian, differences.T @ p - ridge * w), 1.0
        while (after := loss(w + size * step)) > now and size > 1e-4:
            size /= 2
        if now - after < 1e-6:
            break
        w, now = w + size * step, after
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = MAX_TRAIN, text_col: str = "text"):
    """A model from at most `rows` labelled documents outside the held-out fold. Every poor document of one half makes
    pairs with good ones spread over it; the other half sets the share below the cut, where the mean of the two
    labels' accuracies is highest, and the slope."""
    small_batches(docs.sparkSession)
    sample = F.broadcast(training_sample(labels, label, rows))  # `rows` pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(sample, "doc_id")
    coded = texts.select("doc_id", "text", (F.col("label") + 2 * (F.col("part") % 2)).cast("int").alias("label"))
    found = sorted(tuple(r) for r in coded.mapInArrow(_features, "doc_id long, label int, x array<double>").collect())
    width = len(FEATURES)
    x = np.array([r[2] for r in found], float).reshape(-1, width)
    y = np.array([r[1] % 2 for r in found], int)
    half = np.array([r[1] // 2 for r in found], int)
    mean = x.mean(axis=0) if len(x) else np.zeros(width)
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(width)
    z = np.clip((x - mean) / scale, -6, 6)
    good, poor = np.flatnonzero((y == 1) & (half == 0)), np.flatnonzero((y == 0) & (half == 0))
    if not len(good) or not len(poor):
        return Model(mean, scale, np.zeros(width), 0.0, 1.0)
    steps = np.arange(PAIRS_PER_POOR) * max(len(good) // PAIRS_PER_POOR, 1)
    partners = good[(np.arange(len(poor))[:, None] * 7 + steps[None, :]) % len(good)]
    weights = fit_pairs((z[partners] - z[poor][:, None, :]).reshape(-1, width))
    # The cut comes from rows that the weights haven't seen, where there are enough of them.
    seen = half == 1 if len(set(y[half == 1])) == 2 else half == 0
    s, y = z[seen] @ weights, y[seen]
    order = np.argsort(s)
    s, y = s[order], y[order]
    poor_below, good_below = np.cumsum(y == 0) / max((y == 0).sum(), 1), np.cumsum(y == 1) / max((y == 1).sum(), 1)
    best = int(np.argmax(poor_below - good_below))
    centred = (s - s[best]) / max(float(s.std()), 1e-6)
    slope = max(float(fit_logistic(np.stack([centred, np.ones(len(s))], axis=1), y)[0]), 0.1)
    return Model(mean, scale, weights, (best + 1) / len(s), slope / max(float(s.std()), 1e-6))


def _strengths(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in strings(batch.column(2))], float).reshape(-1, len(FEATURES))
            held = pa.array(model.strengths(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], held], ["doc_id", "held_out", "strength"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, strength) of every row.

    The score is a logistic curve of the strength that is 0.3 at the model's quantile of the strengths of all rows;
    predicted is 1 from 0.3 on. A missing text counts as empty. Equal texts have equal scores, an empty table none.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_col)
    strong = settle(narrow.mapInArrow(_strengths(model), "doc_id long, held_out boolean, strength double"), "strengths")
    cut = strong.agg(F.percentile_approx("strength", model.share, 100_000)).first()[0] or 0.0
    curve = (F.col("strength") - cut) * model.slope + math.log(THRESHOLD / (1 - THRESHOLD))
    value = 1 / (1 + F.exp(-F.least(F.greatest(curve, F.lit(-30.0)), F.lit(30.0))))
    above = F.col("strength") > cut
    # Rounding must not carry a score over the threshold that the strength is not over.
    value = F.when(above, F.greatest(value, F.lit(THRESHOLD))).otherwise(F.least(value, F.lit(THRESHOLD - 1e-9)))
    return strong.select("doc_id", "held_out", value.alias("score"), above.cast("int").alias("predicted"), "strength")


def drop_poor(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows predicted poor, judged against the quantile of their own strengths. Rows are told apart
    by id; where rows share an id they stay if one of them does."""
    stays = score(docs, model, id_col, text_col).filter("predicted = 1").select("doc_id").distinct()
    same = docs[id_col].cast("long").eqNullSafe(stays["doc_id"])
    return docs.join(stays, same, "left_semi")
