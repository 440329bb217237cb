"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in features of its form (lengths, shares of kinds of characters,
repetition of words and lines), each cut at quantiles into steps. It is learned from preference
pairs: every pair is a labelled good and a labelled bad document, and the logistic loss of the
difference of their features says how likely the good one is preferred. The decision threshold is
a quantile of the training scores, the one with the best balanced accuracy there; scores are
shifted so that it stands at THRESHOLD after the logistic function.

Fitting reads a bounded sample of the labelled ids (SAMPLE ids by their hash, PAIRS pairs), one row of
features each; scoring reads every whole text, in one map without a shuffle.

Defined results: null or empty text has zero features and gets a score like any other; very long texts are
measured whole; repeated rows get equal scores, and equal scores equal predictions; of several labels of one
id the larger counts, of several documents with a labelled id the one with the least features; labels
that are null or without a document are ignored; without two classes among the labels (as with an empty
table of labels) every score is THRESHOLD; no documents give no rows; other columns are not read.
Ids are integers of at most 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, PAIRS, STEPS, RIDGE, THRESHOLD = 6000, 40_000, 8, 1e-3, 0.3
FEATURES = 16

_KIND = np.zeros(256, np.int64)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"?()-", b"!", b"#$%&*+/<=>@[\\]^_`{|}~"), 1):
    _KIND[list(_set)] = _k


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(FEATURES)
    words = data.split()
    if not words:
        return out
    n, size = len(words), len(data)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7) / size
    lines = data.split(b"\n")
    distinct = set(words)
    same = sum(map(eq, words, words[1:]))
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in distinct)
    out[:7] = kinds
    out[7:] = (
        np.log1p(n),
        np.log1p(size),
        size / n,
        len(distinct) / n,
        same / n,
        len(set(lines)) / len(lines),
        np.log1p(size / len(lines)),
        marked / len(distinct),
        len(distinct) / n**0.7,
    )
    return out


class Model:
    """Steps of each feature, weights, and the shift that puts the threshold at THRESHOLD."""

    def __init__(self, cuts: np.ndarray, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray):
        self.cuts, self.centre, self.spread, self.weights, self.shift = cuts, centre, spread, weights, 0.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        steps = (x[:, :, None] > self.cuts[None]).reshape(len(x), -1)
        return np.concatenate([steps, (x - self.centre) / self.spread], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        # summed row by row, so that a text's score does not depend on its batch
        return (np.clip(self.expand(x), -8, 8) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.shift, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = STEPS, threshold: float = THRESHOLD) -> Model:
    """Newton's method on the logistic loss of the differences of `pairs` seeded preference pairs."""
    base = np.log(threshold / (1 - threshold))
    if not good.any() or good.all():
        m = Model(np.zeros((FEATURES, 0)), np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES))
        m.shift = -base
        return m
    cuts = np.quantile(x, np.linspace(0, 1, steps + 2)[1:-1], axis=0).T
    m = Model(cuts, x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(0))
    wide = np.clip(m.expand(x), -8, 8)
    rng = np.random.Generator(np.random.PCG64(7))
    up, down = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    diff = wide[up] - wide[down]
    w = np.zeros(wide.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))  # chance given to the wrong order
        gradient = diff.T @ p / pairs - RIDGE * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    m.weights = w
    raw = m.raw(x)
    levels = np.quantile(raw, np.linspace(0.005, 0.995, 199))
    balance = [((raw >= t) & good).sum() / good.sum() + ((raw < t) & ~good).sum() / (~good).sum() for t in levels]
    m.shift = levels[int(np.argmax(balance))] - base
    return m


def training_rows(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of a bounded sample of the ids that may be learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return known.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = docs.select("doc_id", "text").join(F.broadcast(training_rows(labels, sample)), "doc_id")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "label": pdf.label, "x": [features(t).tolist() for t in pdf.text]})

    # one row an id before anything comes to the driver, so the sample bounds it
    measured = rows.mapInPandas(measure, "doc_id long, label boolean, x array<double>").groupBy("doc_id", "label").agg(F.min("x").alias("x"))
    got = measured.toPandas().sort_values("doc_id", kind="stable")
    return fit(np.array(got.x.tolist()).reshape(len(got), FEATURES), got.label.to_numpy(bool))


def scorer(model: Model):
    @F.pandas_udf("double")
    def score(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in chunks:
            yield pd.Series(model.score(np.array([features(t) for t in texts]).reshape(len(texts), FEATURES)))

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    score = scorer(train(docs, labels))
    rows = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
