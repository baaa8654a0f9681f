"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are words and word beginnings. Their log-odds between toxic and other labelled documents are taken under a
Dirichlet prior of half a document each way, whatever the sample's size, and a token scores what is left of them after
some standard errors, if that is above a floor; how many errors and which floor is decided on labelled rows that the
counts have not seen. All other words cost a small constant. One linear scan finds all maximal segments of a document (no
part of one scores more than the whole, and none can be extended with profit). By extreme-value theory n clean words have
about E = K n e^(-L S) segments of score S or more by chance, so a segment counts with ln(1 + 1 / E), which grows as
L S once that exceeds ln(K n), and a logistic curve fitted on the unseen labelled rows turns the sum into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocite.llm.common import fresh, small_batches, strings
from echocite.llm.labelled import MAX_TRAIN, fit_logistic, held_out, training_sample
from echocite.session import settle

PRIOR = 0.5  # documents with a token, and without it, that the prior is worth in each class
CHOICES = ((2.0, 0.5), (2.0, 1.0), (2.0, 2.0), (2.0, 3.0), (3.0, 0.5), (3.0, 1.0), (3.0, 2.0))  # (errors, floor)
DRIFT = 0.3  # what a word without a score costs
BEGINNINGS = (6, 5, 4)
HEAD = 4  # letters by which words without a score are told quickly
EULER = 0.5772156649015329

_EDGES = re.compile(r"^\W+|\W+$")


def tokens_of(word: str) -> list[str]:
    """The word without what surrounds it, and its beginnings; beginnings end in a star."""
    word = _EDGES.sub("", word)
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]] if word else []


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score), in linear time.

    `places` ascend and hold the words with a positive score; every word between costs `drift`. Segments are kept on a
    list with the cumulative scores before and after them; a new one is merged with the last whose start lies lower,
    if that one ends lower too.
    """
    held: list[tuple[int, int, float, float]] = []
    total, last = 0.0, None
    for place, score in zip(places, scores):
        total -= drift * (place - (place if last is None else last + 1))
        left, right, first = total, total + score, place
        total, last = right, place
        while held:
            k = len(held) - 1
            while k >= 0 and held[k][2] >= left:
                k -= 1
            if k < 0 or held[k][3] >= right:
                break
            left, first = held[k][2], held[k][0]
            del held[k:]
        held.append((first, place, left, right))
    return [(a, b, r - x) for a, b, x, r in held]


@dataclass(frozen=True)
class Model:
    """Scores of tokens, the extreme-value parameters, and the logistic curve."""

    scores: dict[str, float]
    rate: float = 1.0  # L
    log_k: float = 0.0
    curve: tuple[float, float] = (1.0, 0.0)

    def bar(self, n: int) -> float:
        """What L S exceeds for a segment that n clean words hold less than once."""
        return self.log_k + math.log(max(n, 1))

    def evidence(self, n: int, scores) -> float:
        """The sum of ln(1 + 1 / E) over segments of these scores."""
        return float(np.logaddexp(0, self.rate * np.asarray(scores, float) - self.bar(n)).sum())

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-min(max(a * math.log1p(evidence) + b, -30), 30)))


class Scorer:
    """Segments of texts. A word scores as the longest token it has that is known."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.heads = {t.rstrip("*")[:HEAD] for t in scores}

    def word(self, core: str) -> float | None:
        return next((self.scores[t] for t in tokens_of(core) if t in self.scores), None)

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words, heads = text.lower().split(), self.heads
        places, found = [], []
        for place, word in enumerate(words):
            if not word.isalnum():
                word = _EDGES.sub("", word)
            if word[:HEAD] in heads and (score := self.word(word)) is not None:
                places.append(place)
                found.append(score)
        return len(words), maximal_segments(places, found, DRIFT)


def read(model: Model, scorer: Scorer, text: str) -> tuple[float, list[tuple[int, int, float]]]:
    """A text's score, and its significant segments."""
    n, segments = scorer.segments(text)
    significant = [s for s in segments if model.rate * s[2] > model.bar(n)]
    return model.score(model.evidence(n, [s[2] for s in segments])), significant


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic documents, other documents) of each batch."""
    for batch in batches:
        counts: tuple[dict, dict] = ({}, {})
        known: dict[str, list[str]] = {}
        for text, label in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
            own, words = counts[label], set(text.lower().split())
            known.update((w, tokens_of(w)) for w in words if w not in known)
            for t in {t for w in words for t in known[w]}:
                own[t] = own.get(t, 0) + 1
        names = list(counts[0].keys() | counts[1].keys())
        columns = [[c.get(t, 0) for t in names] for c in (counts[1], counts[0])]
        held = [pa.array(names, pa.string()), *[pa.array(c, pa.int64()) for c in columns]]
        yield pa.RecordBatch.from_arrays(held, ["token", "toxic", "other"])


def token_evidence(sample: DataFrame) -> DataFrame:
    """(token, log_odds, error, share) from (text, label) rows: log-odds of a document that holds the token, their
    standard error, and the share of other documents that hold it. Tokens that no choice scores are left out."""
    counted = sample.mapInArrow(_count_tokens, "token string, toxic long, other long")
    counts = counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    totals = sample.agg(F.sum("label").alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n0 = float(totals["n1"] or 0), float((totals["n"] or 0) - (totals["n1"] or 0))
    in_toxic, in_other = F.col("toxic") + PRIOR, F.col("other") + PRIOR
    odds = F.log(in_toxic / (n1 + 2 * PRIOR - in_toxic)) - F.log(in_other / (n0 + 2 * PRIOR - in_other))
    error = F.sqrt(1 / in_toxic + 1 / in_other)
    share = (in_other / (n0 + 2 * PRIOR)).alias("share")
    found = counts.select("token", odds.alias("log_odds"), error.alias("error"), share)
    mildest = [F.col("log_odds") - z * F.col("error") > floor for z, floor in CHOICES]
    return found.filter(F.greatest(*mildest))


def _scores(tokens: list, choice: tuple[float, float]) -> dict[str, float]:
    z, floor = choice
    lower = ((r["token"], r["log_odds"] - z * r["error"]) for r in tokens)
    return {t: x for t, x in lower if x > floor}


def _measure(choices: list[dict[str, float]]):
    """(choice, words, label, scores of the segments) for every text under every choice of token scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(c) for c in choices]
        for batch in batches:
            rows = [
                (k, n, label, [s[2] for s in segments])
                for text, label in zip(strings(batch.column(0)), batch.column(1).to_pylist())
                for k, scorer in enumerate(scorers)
                for n, segments in [scorer.segments(text)]
            ]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["choice", "words", "label", "scores"])

    return run


def _rate(scores: dict[str, float], shares: dict[str, float], words: float) -> float:
    """The positive L at which a clean word's e^(L score) is 1 on average. A share is of documents of `words` words."""
    gain = [(scores[t], min(shares[t] / max(words, 1.0), 0.05)) for t in scores]
    rest = max(1 - sum(p for _, p in gain), 0.5)
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        mean = rest * math.exp(-middle * DRIFT) + sum(p * math.exp(min(middle * s, 700)) for s, p in gain)
        low, high = (middle, high) if mean < 1 else (low, middle)
    return max(low, 1e-3)


def _fitted(scores: dict[str, float], shares: dict[str, float], seen: list) -> tuple[float, Model]:
    """The log loss over unseen rows (words, label, scores), and the model with its parameters fitted on them."""
    clean = [r for r in seen if r["label"] == 0]
    words = float(np.mean([r["words"] for r in clean])) if clean else 1.0
    rate = _rate(scores, shares, words)
    hit = [(rate * max(r["scores"]), max(r["words"], 1)) for r in clean if r["scores"]]
    if hit:  # the median of a clean document's best segment, of those with any, against that of a Gumbel
        log_k = float(np.median([best - math.log(n) for best, n in hit])) + math.log(math.log(2))
    else:
        log_k = -math.log(max(words, 1.0))
    model = Model(scores, rate, log_k)
    if not seen:
        return 0.0, model
    evidence = np.array([model.evidence(r["words"], r["scores"]) for r in seen])
    y = np.array([r["label"] for r in seen], float)
    a, b = fit_logistic(np.stack([np.log1p(evidence), np.ones(len(seen))], axis=1), y, ridge=0.1)
    model = Model(scores, rate, log_k, (max(float(a), 0.0), float(b)))
    p = np.clip([model.score(e) for e in evidence], 1e-9, 1 - 1e-9)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))), model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = MAX_TRAIN, text_col: str = "text"):
    """A model from at most `rows` labelled documents outside the held-out fold: token counts from three quarters of their
    distinct texts, all else from the rest. Equal texts count once, with their greatest label. Nothing that the driver
    receives grows beyond the sample. Without labels of both kinds every score is the same."""
    small_batches(docs.sparkSession)
    sample = F.broadcast(training_sample(labels, label, rows))  # `rows` pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = texts.join(sample, "doc_id").groupBy("text").agg(F.max("label").alias("label"))
    texts = settle(texts.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4))), "labelled-texts")
    tokens = token_evidence(texts.filter("part < 3").select("text", "label")).collect()
    shares = {r["token"]: r["share"] for r in tokens}
    choices = [_scores(tokens, c) for c in CHOICES]
    measured = "choice long, words long, label long, scores array<double>"
    unseen = texts.filter("part = 3").select("text", "label").mapInArrow(_measure(choices), measured).collect()
    unseen.sort()  # so that sums don't depend on the order of tasks
    fits = [_fitted(c, shares, [r for r in unseen if r["choice"] == k]) for k, c in enumerate(choices)]
    return min(fits, key=lambda f: f[0])[1]


RESULT = "doc_id long, held_out boolean, score double, predicted int, n_passages long, passages array<struct<first:long,last:long,score:double>>"


def _apply(model: Model, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.scores)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            found = [read(model, scorer, text) for text in strings(batch.column(columns))]
            scores = [s for s, _ in found]
            passages = [[{"first": a, "last": b, "score": s} for a, b, s in own] for _, own in found]
            held = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            held += [pa.array([len(p) for p in passages], pa.int64()), pa.array(passages, kind)]
            names = [f.name for f in batch.schema][:columns] + ["score", "predicted", "n_passages", "passages"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], *held], names)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passages) of every row.

    passages are the significant segments, as numbers of words between white space, from 0, with their scores. A
    missing or empty text has none and the lowest score there is. Equal texts have equal scores.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_col)
    return narrow.mapInArrow(_apply(model, 2), RESULT)


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that are predicted toxic."""
    small_batches(docs.sparkSession)
    mark = fresh(docs, "toxic_score")

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.scores)
        for texts in batches:
            yield texts.map(lambda t: read(model, scorer, t or "")[0])

    return docs.withColumn(mark, scores(F.col(text_col))).filter(F.col(mark) < 0.5).drop(mark)
