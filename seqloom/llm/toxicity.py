"""Toxicity by a chain of linear classifiers.

Categories come in a fixed order, and each one's model sees the words of a text and the
probabilities of the categories before it. While training, those come from models fitted on the
other folds (out of fold; copies of a text share a fold), so a later model learns from what the earlier
ones will really say about unseen text. The last category is the label itself; the ones before it are the
two kinds of toxic text that differ most, whatever the language: the sides of the main direction in which
the labelled toxic rows' telling words vary.

Words are chosen over a bounded sample of labelled ids: those whose presence tells most about
the label, as long as several rows hold them. Scoring reads every whole text in one map. With few
labelled toxic documents few are found: at least LEAST_ROWS must share a word.

Defined results: null or empty text has no words and is scored like any other; very long texts are read
whole; repeated rows get equal scores, and equal scores equal verdicts (a score at the threshold is toxic);
of several labels of one id the larger counts, of several documents with a labelled id the one with the
least sequence of words; labels that are null or without a document are ignored; without two classes among
the labels (as with an empty table of labels) every probability is 0; no documents give no rows; other
columns are kept by reject() and not read by score(). Ids are integers of at most 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import unused

CHAIN = ("kind_1", "kind_2", "toxic")
SAMPLE, WORDS, LEAST_ROWS, FOLDS, RIDGE, THRESHOLD, PRECISION = 12_000, 200, 5, 3, 1.0, 0.5, 0.97
NEWTON_STEPS = 100
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a logistic regression; the last one is the intercept. The penalized loss is convex and falls with every
    step: a full Newton step that overshoots is halved, as it may otherwise end where every text is toxic."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    loss = lambda w: np.logaddexp(0, (1 - 2 * y) * (x @ w)).sum() + penalty @ w**2 / 2
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (y - p) - penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        gain = gradient @ step
        if gain < 1e-9:
            break
        before, part = loss(w), 1.0
        while loss(w + part * step) > before - 1e-4 * part * gain and part > 1e-9:
            part /= 2
        w = w + part * step
    return w


def _chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    # summed row by row, so that a text's chance does not depend on its batch
    return 1 / (1 + np.exp(-np.clip((x * w[:-1]).sum(axis=1) + w[-1], -30, 30)))


class Chain:
    """vocabulary: word -> column; weights: one vector for each category of CHAIN; threshold: of the last one."""

    def __init__(self, vocabulary: dict[str, int], weights: list[np.ndarray], threshold: float = THRESHOLD):
        self.vocabulary, self.weights, self.threshold = vocabulary, weights, threshold

    def columns(self, text: str | None) -> list[int]:
        return sorted(self.vocabulary[w] for w in words_of(text) & self.vocabulary.keys())

    def predict(self, present: list[list[int]]) -> np.ndarray:
        """One column of probabilities for each category."""
        if not self.weights:
            return np.zeros((len(present), len(CHAIN)))
        x = _dense(present, len(self.vocabulary))
        for w in self.weights:
            x = np.column_stack([x, _chance(x, w)])
        return x[:, len(self.vocabulary) :]


def _dense(present: list[list[int]], width: int) -> np.ndarray:
    x = np.zeros((len(present), width))
    for i, columns in enumerate(present):
        x[i, columns] = 1
    return x


def fit_chain(vocabulary: dict[str, int], present: list[list[int]], marks: np.ndarray, fold: np.ndarray) -> Chain:
    """marks: 0/1, a column for each category; fold: a number below FOLDS for each row."""
    x, weights, unseen = _dense(present, len(vocabulary)), [], np.zeros(len(present))
    for k in range(marks.shape[1]):
        y = marks[:, k].astype(float)
        weights.append(_logistic(x, y))
        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            out = fold == f
            if out.any():
                unseen[out] = _chance(x[out], _logistic(x[~out], y[~out])) if (~out).any() else y.mean()
        x = np.column_stack([x, unseen])
    return Chain(vocabulary, weights, best_threshold(unseen, marks[:, -1] == 1))


def best_threshold(chance: np.ndarray, label: np.ndarray) -> float:
    """The threshold with the best recall among those of PRECISION or more over out-of-fold chances:
    halfway (in log odds) between the least chance it takes and the next one below, THRESHOLD at most.
    THRESHOLD where no threshold is that precise."""
    order = np.argsort(-chance, kind="stable")
    hits, taken = np.cumsum(label[order]), np.arange(1, len(label) + 1)
    last = np.append(chance[order][1:] < chance[order][:-1], True)  # ties are taken together
    recall = np.where(last & (hits >= PRECISION * taken), hits, 0)
    k = int(np.argmax(recall))
    if not recall[k]:
        return THRESHOLD
    odds = lambda p: np.log(p / (1 - p))
    edge = np.clip(chance[order][[k, min(k + 1, len(label) - 1)]], 1e-9, 1 - 1e-9)
    return float(min(THRESHOLD, 1 / (1 + np.exp(-odds(edge).mean()))))


def kinds(present: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """(rows, 2) marks: on which side of the toxic rows' main direction each of them lies; none for the others."""
    out = np.zeros((len(present), 2), int)
    rows = np.flatnonzero(toxic)
    if len(rows):
        x = present[rows] - present[rows].mean(axis=0)
        direction = np.linalg.svd(x.T @ x)[0][:, 0]
        direction = direction * np.sign(direction[np.argmax(np.abs(direction))])  # an eigenvector has no sign of its own
        side = x @ direction > 1e-9
        out[rows, 0], out[rows, 1] = side, ~side
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            folds = [crc32((t or "").encode("utf-8", "replace")) % FOLDS for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "toxic": pdf.toxic, "words": [sorted(words_of(t)) for t in pdf.text], "fold": folds})

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.mapInPandas(split, "doc_id long, toxic int, words array<string>, fold int")
    # one row an id, so the sample bounds what follows
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("words", "fold")).alias("one")).select("doc_id", "toxic", "one.*").persist()
    try:
        n, n_toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
        if not n or not n_toxic or n == n_toxic:
            return Chain({}, [])
        held = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
        odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (n - n_toxic + 1.0))
        best = held.where(F.col("n") >= LEAST_ROWS).orderBy(F.desc(F.abs(odds) * F.sqrt("n")), "word").limit(WORDS)
        vocabulary = {w: i for i, w in enumerate(sorted(r["word"] for r in best.collect()))}
        wanted = F.array(*[F.lit(w) for w in sorted(vocabulary)]).cast("array<string>")
        got = rows.select("doc_id", "toxic", "fold", F.array_intersect("words", wanted).alias("words")).toPandas().sort_values("doc_id", kind="stable")
    finally:
        rows.unpersist()
    present, toxic = [sorted(vocabulary[w] for w in ws) for ws in got.words], got.toxic.to_numpy(int)
    marks = np.column_stack([kinds(_dense(present, len(vocabulary)), toxic == 1), toxic])
    return fit_chain(vocabulary, present, marks, got.fold.to_numpy(int))


def scorer(chain: Chain):
    """A column function: struct of the probabilities, named p_<category>."""

    @F.pandas_udf(", ".join(f"p_{c} double" for c in CHAIN))
    def score(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in chunks:
            p = chain.predict([chain.columns(t) for t in texts])
            yield pd.DataFrame({f"p_{c}": p[:, k] for k, c in enumerate(CHAIN)})

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_kind_1, p_kind_2, p_toxic, toxic) of every document."""
    chain = train(docs, labels)
    rows = docs.select("doc_id", scorer(chain)("text").alias("p")).select("doc_id", "p.*")
    return rows.withColumn("toxic", (F.col("p_toxic") >= chain.threshold).cast("int"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose last category is as likely as the chain's threshold or likelier."""
    chain, p = train(docs, labels), unused(docs, "__p")
    marked = docs.withColumn(p, scorer(chain)("text"))
    return marked.where(F.col(p)["p_toxic"] < chain.threshold).select(*docs.columns)
