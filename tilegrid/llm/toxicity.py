"""Operator 6: severity of toxic language by cumulative-link ordinal regression.

Grades are ordered: 0 clean, 1 toxic, 2 severely toxic. One weight vector over words and word beginnings is shared by all
thresholds: P(grade <= k) = sigmoid(threshold_k - w.x). The labels know only clean and toxic, so the upper grade is taken from
the texts: a labelled toxic text is graded 2 if it has more of the features that set toxic texts apart than the median labelled
toxic text. The output is the expected grade; a text is toxic if P(grade > 0) is at least one half.

Fitting takes a bounded sample of labelled rows (``SAMPLE``), in one task; every whole text is scored, without Spark shuffling
texts.

Defined cases: null, empty and wordless texts have no features and so the prior's severity; without any toxic or any clean labels
all severities are 0 and nothing is rejected; P(grade > 0) of exactly one half is toxic; rows with a null doc_id are scored too; further
columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tilegrid.llm.features import SIZE, word_counts
from tilegrid.llm.kernels import tidied
from tilegrid.llm.labelled import labelled_sample
from tilegrid.llm.shared import bound_batches

#: Labelled documents to fit on, features kept, the ridge penalty, and steps of the fit.
SAMPLE, KEPT, RIDGE, STEPS = 12_000, 8192, 0.03, 300
#: Standard errors by which a feature's log odds must differ between toxic and clean texts; others would only add noise in long texts.
CLEAR = 3.0


@dataclass
class Severity:
    """A fitted model: weights by feature id, and ascending thresholds."""

    ids: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def slope(theta: np.ndarray, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray]:
    """Penalised negative log likelihood of the grades, and its gradient. ``theta``: weights, the lower threshold, the log of the step to the upper one."""
    n, weights, low, gap = len(grade), theta[:-2], theta[-2], theta[-1]
    score = np.bincount(rows, vals * weights[cols], n)
    below, upto = _sigmoid(low - score), _sigmoid(low + np.exp(gap) - score)
    d_low, d_high = below * (1 - below), upto * (1 - upto)
    chance = np.maximum(np.choose(grade, (below, upto - below, 1 - upto)), 1e-9)
    by_low = np.choose(grade, (d_low, -d_low, np.zeros(n))) / chance
    by_high = np.choose(grade, (np.zeros(n), d_high, -d_high)) / chance
    by_weight = np.bincount(cols, vals * (by_low + by_high)[rows], len(weights)) + RIDGE * weights
    by_thresholds = [-(by_low + by_high).sum(), -by_high.sum() * np.exp(gap)]
    return float(RIDGE * (weights @ weights) / 2 - np.log(chance).sum()), np.concatenate((by_weight, by_thresholds))


def fit(texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> Severity:
    """``texts``: distinct feature ids and counts of each text; ``toxic``: 0 or 1."""
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    if not n1 or not n0:
        return Severity(np.zeros(0, np.int64), np.zeros(0), np.array([np.inf, np.inf]))
    seen = np.zeros((2, SIZE), np.int32)
    for (ids, _), y in zip(texts, toxic, strict=True):
        seen[y, ids] += 1
    p1, p0 = (seen[1] + 0.5) / (n1 + 1), (seen[0] + 0.5) / (n0 + 1)
    far = (np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0))) / np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5) + 1 / n1 + 1 / n0)
    far[seen.sum(0) < 3] = 0
    ids = np.sort(np.argsort(-np.abs(far), kind="stable")[:KEPT])
    ids = ids[np.abs(far[ids]) >= CLEAR]
    column = np.full(SIZE, -1, np.int32)
    column[ids] = np.arange(len(ids))
    marker = far[ids] > 0
    cols, rows, vals = [], [], []
    for r, (own, counts) in enumerate(texts):
        c = column[own]
        cols.append(c[c >= 0])
        vals.append(np.log2(1.0 + counts[c >= 0]))
        rows.append(np.full(len(cols[-1]), r))
    cols, rows, vals = np.concatenate(cols), np.concatenate(rows), np.concatenate(vals)
    evidence = np.bincount(rows, vals * marker[cols], len(toxic))
    grade = np.where(toxic == 1, 1 + (evidence > np.median(evidence[toxic == 1])), 0)
    # Adam on the penalised likelihood.
    theta = np.concatenate((np.zeros(len(ids)), [np.log(n0 / n1), 0.0]))
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, STEPS + 1):
        _, down = slope(theta, rows, cols, vals, grade)
        m, v = 0.9 * m + 0.1 * down, 0.99 * v + 0.01 * down**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Severity(ids, theta[:-2], np.array([theta[-2], theta[-2] + np.exp(theta[-1])]))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Severity:
    """Fit on a sample of at most ``most`` labelled documents; only the model comes to the driver."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += ((ids, n.astype(np.int32)) for ids, n in word_counts(batch.column("text")))
            toxic += batch.column("label").to_pylist()
        model = fit(texts, np.minimum(np.array(toxic, np.int64), 1))
        ids = np.concatenate((model.ids, [-1, -2]))
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(np.concatenate((model.weights, model.thresholds)))], ["id", "weight"])

    rows = labelled_sample(docs, labels, "toxic", most).mapInArrow(lambda batches: tidied(run(batches)), "id long, weight double").toPandas()  # at most KEPT + 2 rows
    found = dict(zip(rows["id"], rows["weight"], strict=True))
    thresholds = np.array([found.pop(-1, np.inf), found.pop(-2, np.inf)])
    return Severity(np.array([*found], np.int64), np.array([*found.values()]), thresholds)


def severity(docs: DataFrame, model: Severity) -> DataFrame:
    """``docs`` with severity (expected grade, 0 to 2), p_toxic (0 to 1) and toxic."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("severity", "p_toxic", "toxic")]
    ids, weights, thresholds = model.ids, model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SIZE)
        table[ids] = weights
        wanted = table != 0
        own = Severity(ids, weights, thresholds)
        for batch in batches:
            found = word_counts(batch.column(batch.schema.get_field_index("text")), wanted)
            score = np.array([table[i] @ np.log2(1.0 + n) if len(i) else 0.0 for i, n in found], float)
            chance = own.exceed(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance.sum(1)), pa.array(chance[:, 0]), pa.array(chance[:, 0] >= 0.5)], [*batch.schema.names, "severity", "p_toxic", "toxic"])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = StructType([*rows.schema, StructField("severity", DoubleType()), StructField("p_toxic", DoubleType()), StructField("toxic", BooleanType())])
    return rows.mapInArrow(lambda batches: tidied(run(batches)), schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with their columns."""
    return severity(docs, train(docs, labels, most)).where(~F.col("toxic")).select(*(F.col(f"`{c}`") for c in docs.columns))
