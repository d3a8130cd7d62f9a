"""Operator 2: a quality classifier by naive Bayes support vectors.

Indicators of n-grams (byte trigrams, words, pairs of words; all pairs of equal words are one) are scaled by the log ratio of their smoothed
shares in the two classes, and with them indicators of repetition: that 1, 2, 4, ... words of a text equal the word before, which are no
n-grams; a linear hinge-loss model is then fitted on the scaled vectors, of unit length, by dual coordinate descent. A logistic
curve, fitted on labelled rows kept from the descent, turns margins into scores.

Fitting takes a bounded sample of labelled rows (``SAMPLE``) that aren't held out, in one task; every whole text is scored, without
Spark shuffling texts.

Defined cases: null, empty and wordless texts have no n-grams and get the score of margin 0 plus the bias; without labels of both
classes every score is the share of label 1 (0.5 without labels); rows with a null doc_id are scored and not held out; further
columns are ignored; doc_id must be a whole number (cast to long).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilegrid.llm.features import SIZE, gram_features
from tilegrid.llm.kernels import tidied
from tilegrid.llm.labelled import labelled_sample
from tilegrid.llm.shared import bound_batches

#: Labelled documents to fit on, the hinge loss's weight, passes of the descent, and every how many-th row is kept for the curve.
SAMPLE, COST, PASSES, CURVE = 12_000, 1.0, 12, 5
#: Added to the counts of both classes; and in how many texts of the sample a feature must occur.
SMOOTHING, LEAST = 1.0, 3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def ratios(grams: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Log of a feature's smoothed share among label 1 over that among label 0."""
    seen = np.full((2, SIZE), SMOOTHING)
    for ids, y in zip(grams, label, strict=True):
        seen[y, ids] += 1
    used = (seen.sum(0) >= 2 * SMOOTHING + LEAST)[None]
    total = (seen * used).sum(1, keepdims=True)
    return (np.log(seen[1] / total[1]) - np.log(seen[0] / total[0])) * used[0]


def descend(grams: list[np.ndarray], label: np.ndarray, r: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * (hinge loss, both classes weighing alike), by dual coordinate descent."""
    y = np.where(label == 1, 1.0, -1.0)
    values = [unit(r[ids]) for ids in grams]
    share = np.bincount(label, minlength=2) / len(label)
    upper = np.where(label == 1, 0.5 / share[1], 0.5 / share[0]) * cost
    alpha, w, bias = np.zeros(len(y)), np.zeros(SIZE), 0.0
    curved = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(1)
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            ids, v = grams[i], values[i]
            slope = y[i] * (w[ids] @ v + bias) - 1
            new = min(max(alpha[i] - slope / curved[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[ids] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def margins(grams: list[np.ndarray], r: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([w[ids] @ unit(r[ids]) + bias for ids in grams], float)


def curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to labels, by Newton steps on smoothed targets."""
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack((margin, np.ones(len(margin))), 1)
    beta = np.array([2.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target))
    return float(max(beta[0], 1e-3)), float(beta[1])


@dataclass
class Model:
    """Ratio and weight by feature id, the margin's bias, and the curve from margins to scores."""

    ids: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def packed(self) -> list[bytes]:
        parts = (self.ids.astype("<i4"), self.ratio.astype("<f4"), self.weight.astype("<f4"), np.array([self.bias, self.slope, self.offset], "<f8"))
        return [x.tobytes() for x in parts]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Model:
        ids, ratio, weight, rest = (np.frombuffer(x, t) for x, t in zip(parts, ("<i4", "<f4", "<f4", "<f8"), strict=True))
        return cls(ids, ratio, weight, *map(float, rest))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        r, w = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)
        r[self.ids], w[self.ids] = self.ratio, self.weight
        return r, w

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def fit(grams: list[np.ndarray], label: np.ndarray) -> Model:
    if len(set(label.tolist())) < 2:
        share = float(np.clip(label.mean() if len(label) else 0.5, 1e-6, 1 - 1e-6))
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), offset=float(np.log(share / (1 - share))))
    late = np.arange(len(label)) % CURVE == 0
    early = ~late
    if min(np.bincount(label[late], minlength=2).min(), np.bincount(label[early], minlength=2).min()) < 1:
        late = early = np.ones(len(label), bool)
    own = [g for g, k in zip(grams, early, strict=True) if k]
    r = ratios(own, label[early])
    w, bias = descend(own, label[early], r)
    ids = np.flatnonzero(r)
    return Model(ids, r[ids], w[ids], bias, *curve(margins([g for g, k in zip(grams, late, strict=True) if k], r, w, bias), label[late]))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit on a sample; the model (of at most 2**20 features) comes to the driver as one row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, label = [], []
        for batch in batches:
            grams += gram_features(batch.column("text"))
            label += batch.column("label").to_pylist()
        parts = fit(grams, np.minimum(np.array(label, np.int64), 1)).packed()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["ids", "ratio", "weight", "rest"])

    rows = labelled_sample(docs, labels, "quality", most, ~held_out(F.col("doc_id")))
    row = rows.mapInArrow(lambda batches: tidied(run(batches)), "ids binary, ratio binary, weight binary, rest binary").first()
    return Model.unpacked([bytes(x) for x in row]) if row else fit([], np.zeros(0, np.int64))


def score_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) of every row."""
    spark = docs.sparkSession
    parts = spark.sparkContext.broadcast(train(docs, labels, most).packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model.unpacked(parts.value)
        r, w = fitted.tables()
        for batch in batches:
            score = fitted.score(margins(gram_features(batch.column("text")), r, w, fitted.bias))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: tidied(run(batches)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
