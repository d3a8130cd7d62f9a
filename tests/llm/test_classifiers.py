"""The two classifiers against slow and plain versions, and on labels they didn't see."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilegrid.llm import quality_model as nb
from tilegrid.llm import toxicity as tox
from tilegrid.llm.features import SIZE, gram_features, word_counts

MORE = "/root/testdata/sf0.01"


def _toy(seed, n=40):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, n)
    grams = [np.unique(np.concatenate((rng.integers(0, 30, 6), rng.integers(30 + 10 * y, 45 + 10 * y, 4)))).astype(np.uint32) for y in label]
    return grams, label


def test_ratios_by_hand():
    grams = [np.array(x, np.uint32) for x in ([1, 2], [1, 2], [1, 3], [2, 4])]
    label = np.array([1, 1, 0, 0])
    r = nb.ratios(grams, label)
    # 1 is in two texts of label 1 and one of label 0, 2 likewise; 3 and 4 occur once and don't count. Totals with one added: 6 and 4.
    want = math.log(3 / 6) - math.log(2 / 4)
    assert r[1] == pytest.approx(want) and r[2] == pytest.approx(want) and r[3] == r[4] == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_descent_reaches_the_optimum(seed):
    grams, label = _toy(seed)
    r = nb.ratios(grams, label)
    w, bias = nb.descend(grams, label, r, cost=1.0, passes=500)
    y, x = np.where(label == 1, 1.0, -1.0), np.zeros((len(label), 101))
    for i, ids in enumerate(grams):
        x[i, ids] = nb.unit(r[ids])
        x[i, 100] = 1  # the bias
    share = np.bincount(label, minlength=2) / len(label)
    upper = np.where(label == 1, 0.5 / share[1], 0.5 / share[0])
    loss = lambda v: v @ v / 2 + (upper * np.maximum(0, 1 - y * (x @ v))).sum()
    # The dual by projected gradient steps, which is slow but plain.
    q, alpha = (x @ x.T) * np.outer(y, y), np.zeros(len(y))
    for _ in range(20_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, upper)
    dual = alpha.sum() - alpha @ q @ alpha / 2
    own = np.concatenate((w[:100], [bias]))
    assert loss(x.T @ (alpha * y)) - dual < 1e-3 and dual - 1e-6 <= loss(own) <= dual + 1e-2 and not w[100:].any()


def test_curve_is_where_its_gradient_vanishes():
    rng = np.random.default_rng(5)
    margin = rng.normal(0, 1, 200)
    label = (margin + rng.normal(0, 1, 200) > 0).astype(int)
    a, b = nb.curve(margin, label)
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = 1 / (1 + np.exp(-(a * margin + b)))
    # The ridge of the steps is no part of the objective, so the gradient itself goes to zero.
    assert abs(((p - target) * margin).sum()) < 1e-3 and abs((p - target).sum()) < 1e-3


def _grams(text):
    words, raw = text.split(), text.encode()
    pairs = {"same" if a == b else (a, b) for a, b in zip(words, words[1:], strict=False)}
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return set(words) | {("pair", p) for p in pairs} | {raw[i : i + 3] for i in range(len(raw) - 2)} | {("times", k) for k in range(same.bit_length())}


def test_grams_and_counts_against_plain_sets():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "bb", "Bb", "ccc", "d,d", "é"]) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    got, want = gram_features(pa.array(texts)), [_grams(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert all(len(set(a) & set(b)) == len(x & y) for a, x in zip(got[:20], want, strict=False) for b, y in zip(got, want, strict=True))
    for t, (ids, n) in zip(texts, word_counts(pa.array(texts)), strict=True):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        assert n.sum() == len(words) and len(ids) == len(set(words))


def test_scores_by_hand(spark):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    model = nb.train(docs, labels)
    r, w = model.tables()
    rows = docs.where("doc_id % 10 = 3").select("doc_id", "text").collect()
    got = {x.doc_id: x for x in nb.score_quality(docs, labels).collect()}
    for row in rows:
        (ids,) = gram_features(pa.array([row.text or ""]))
        length = math.sqrt(sum(float(r[i]) ** 2 for i in ids)) or 1.0
        margin = sum(float(r[i]) * float(w[i]) for i in ids) / length + model.bias
        score = 1 / (1 + math.exp(-(model.slope * margin + model.offset)))
        assert got[row.doc_id].score == pytest.approx(score, abs=1e-4) and got[row.doc_id].predicted == int(got[row.doc_id].score >= 0.5)


def test_slope_against_finite_differences():
    rng = np.random.default_rng(4)
    rows, cols, vals = np.repeat(np.arange(30), 4), rng.integers(0, 12, 120), rng.uniform(0.5, 3, 120)
    grade, theta = rng.integers(0, 3, 30), rng.normal(0, 0.3, 14)
    _, own = tox.slope(theta, rows, cols, vals, grade)
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        up, down = (tox.slope(theta + s * step, rows, cols, vals, grade)[0] for s in (1, -1))
        assert own[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)
    score = [sum(v * theta[c] for r, c, v in zip(rows, cols, vals, strict=True) if r == k) for k in range(30)]
    low, high = theta[-2], theta[-2] + math.exp(theta[-1])
    sig = lambda x: 1 / (1 + math.exp(-x))
    chance = [(sig(low - s), sig(high - s) - sig(low - s), 1 - sig(high - s))[g] for s, g in zip(score, grade, strict=True)]
    assert tox.slope(theta, rows, cols, vals, grade)[0] == pytest.approx(-sum(map(math.log, chance)) + tox.RIDGE * sum(t * t for t in theta[:-2]) / 2)


def test_severity_by_hand(spark):
    texts = ["vile vile word", "word", None, "vile"]
    (ids, _), *_ = word_counts(pa.array(["vile"]))
    model = tox.Severity(ids.astype(np.int64), np.full(len(ids), 0.7), np.array([0.7, 2.0]))
    rows = {r.doc_id: r for r in tox.severity(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), model).collect()}
    for i, n in ((0, 2), (1, 0), (2, 0), (3, 1)):
        score = 0.7 * math.log2(1 + n) * len(ids)
        over = [1 / (1 + math.exp(t - score)) for t in (0.7, 2.0)]
        assert rows[i].p_toxic == pytest.approx(over[0]) and rows[i].severity == pytest.approx(sum(over)) and rows[i].toxic == (over[0] >= 0.5)
    half = tox.Severity(np.zeros(0, np.int64), np.zeros(0), np.array([0.0, 1.0]))
    tie = tox.severity(spark.createDataFrame([(1, "x")], "doc_id long, text string"), half).first()
    assert tie.p_toxic == 0.5 and tie.toxic


def test_severity_on_unseen_labels(spark):
    """Half of the labels of the larger tables tell what the other half would: toxic documents are found and clean ones stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = tox.train(docs, labels.where("doc_id % 2 = 1"))
    assert model.thresholds[0] < model.thresholds[1]
    unseen = labels.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("y"))
    rows = tox.severity(docs.join(unseen, "doc_id"), model).select("y", "toxic", "severity", "p_toxic").collect()
    toxic, clean = [r for r in rows if r.y == 1], [r for r in rows if r.y == 0]
    missed, rejected = sum(not r.toxic for r in toxic), sum(r.toxic for r in clean)
    assert len(toxic) > 200 and missed / len(toxic) < 0.1 and rejected / len(clean) < 0.01, (missed, len(toxic), rejected, len(clean))
    assert all(0 <= r.severity <= 2 and r.toxic == (r.p_toxic >= 0.5) for r in rows)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i} " * 20) for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    rows = nb.labelled_sample(docs, labels, "quality", 20).collect()
    assert len(rows) == 20 and len({r.doc_id for r in rows}) == 20
    few = nb.labelled_sample(docs, labels, "quality", 20, most_bytes=1000).collect()
    assert 0 < len(few) < 8 and sum(len(r.text) for r in few) <= 1000 and {r.doc_id for r in few} <= {r.doc_id for r in rows}
    assert SIZE == 1 << 20
