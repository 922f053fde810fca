"""The fitted likelihoods: slopes against differences, optimum, and scores recomputed by hand; the registered queries on given tables."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainfit.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_slopes_of_the_ordinal_likelihood():
    rng = np.random.default_rng(2)
    grades, rows, ids, values = rng.integers(0, 4, 30), rng.integers(0, 30, 90), rng.integers(0, 5, 90), rng.random(90)
    w, raw = rng.normal(size=5), np.array([-0.5, 0.1, -0.3])
    _, d_w, d_raw = quality.ordinal_loss(w, raw, grades, rows, ids, values)
    for x, d in ((w, d_w), (raw, d_raw)):
        for k in range(len(x)):
            step = np.zeros(len(x))
            step[k] = 1e-5
            a, b = (quality.ordinal_loss(w + s if x is w else w, raw + s if x is raw else raw, grades, rows, ids, values)[0] for s in (step, -step))
            assert d[k] == pytest.approx((a - b) / 2e-5, abs=1e-7)
    # The likelihood itself, grade by grade.
    theta, score = np.cumsum([raw[0], *np.exp(raw[1:])]), np.bincount(rows, w[ids] * values, 30)
    tails = [np.ones(30), *(1 / (1 + np.exp(t - score)) for t in theta), np.zeros(30)]
    want = -np.mean([np.log(tails[g][i] - tails[g + 1][i]) for i, g in enumerate(grades)]) + quality.RIDGE / 2 * w @ w
    assert quality.ordinal_loss(w, raw, grades, rows, ids, values)[0] == pytest.approx(want)


def test_the_ordinal_fit_is_near_the_optimum():
    rng = np.random.default_rng(5)
    present = rng.random((600, 4)) < 0.5
    grades = np.digitize(present @ np.array([2.0, -1.0, 1.0, 0.0]) + rng.logistic(size=600), [0.0, 1.5])
    bags = [(np.flatnonzero(p).astype(np.int32), np.full(p.sum(), 0.1, np.float32)) for p in present]
    model = quality.fit_ordinal(grades, bags, 3)
    assert model.weights[[0, 1, 2, 3]] / 10 == pytest.approx([2.0, -1.0, 1.0, 0.0], abs=0.5)
    rows, ids = np.nonzero(present)
    raw = np.array([model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0])])
    loss, d_w, d_raw = quality.ordinal_loss(model.weights[:4] / quality.GAIN, raw, grades, rows, ids, np.full(len(ids), 0.1 * quality.GAIN))
    assert max(abs(d_w).max(), abs(d_raw).max()) < 0.01


def test_slopes_of_the_noisy_or_likelihood():
    rng = np.random.default_rng(3)
    owner, sentence, ids = np.sort(rng.integers(0, 12, 40)), rng.integers(0, 40, 120), rng.integers(0, 6, 120)
    labels, w, b = rng.integers(0, 2, 12), rng.normal(size=6), -1.0
    labels[np.setdiff1d(np.arange(12), owner)] = 0  # a document without sentences can't be explained as toxic
    loss, d_w, d_b = toxicity.noisy_or_loss(w, b, labels, owner, sentence, ids)
    p = 1 / (1 + np.exp(-np.bincount(sentence, w[ids], 40) - b))
    some = [1 - np.prod(1 - p[owner == i]) for i in range(12)]
    want = -sum(np.log(s) if y else np.log(1 - s) for s, y in zip(some, labels, strict=True)) + toxicity.RIDGE * 12 / 200 * w @ w
    assert loss == pytest.approx(want)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-5
        a, c = (toxicity.noisy_or_loss(w + s, b, labels, owner, sentence, ids)[0] for s in (step, -step))
        assert d_w[k] == pytest.approx((a - c) / 2e-5, abs=1e-5)
    a, c = (toxicity.noisy_or_loss(w, b + s, labels, owner, sentence, ids)[0] for s in (1e-5, -1e-5))
    assert d_b == pytest.approx((a - c) / 2e-5, abs=1e-5)


def test_registered_toxicity_is_its_model_by_hand(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, SF).collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in labels if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in held]) >= 0.95
    table = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), table.filter(~queries.held_out()), F.col("toxic"))
    for i in [*docs][:150]:
        none = 1.0
        for s in re.split(r"[.!?\n]", (docs[i] or "").lower()):
            found = [sum(float(model.weights[b]) for b in toxicity.buckets(w)) for w in re.findall(r"[^\W_]+", s)]
            if any(found):
                none *= 1 - 1 / (1 + np.exp(-np.clip(sum(found) + model.start, -30, 30)))
        assert got[i].score == pytest.approx(1 - none, abs=1e-9)


def test_registered_quality_is_its_model_by_hand(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    got = {r.doc_id: r for r in queries.op5_quality(spark, SF).collect()}
    assert got.keys() == docs.keys()
    assert np.mean([got[i].selected == labels[i] for i in labels]) >= 0.95
    model = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), queries.grade(), 3)
    for i in [*docs][:150]:
        tokens = (docs[i] or "").split()
        score = sum(model.weights[b] for t in tokens for b in quality.features(t)) / max(len(tokens), 1)
        score += model.weights[quality.AGAIN] * (sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / len(tokens) if tokens else 0)
        tails = [1 / (1 + np.exp(-np.clip(score - t, -40, 40))) for t in model.thresholds]
        assert got[i].expected_grade == pytest.approx(sum(tails), abs=1e-6) and got[i].tail_probability == pytest.approx(tails[0], abs=1e-6)


def test_clashing_names_and_long_shapes(spark):
    rows = spark.createDataFrame([(1, "some words here", "a", "b")], "doc_id long, text string, read string, __text string")
    none = quality.Ordinal(np.zeros(quality.BUCKETS), np.array([0.0, 1.0]))
    assert quality.score_quality(rows, none).columns == ["doc_id", "text", "read", "__text", "expected_grade", "tail_probability"]
    got = toxicity.score_toxicity(rows, toxicity.NoisyOr(np.zeros(toxicity.BUCKETS), -3.0))
    assert got.columns == ["doc_id", "text", "read", "__text", "toxicity"] and got.first()["read"] == "a"
    assert toxicity.score_toxicity(rows.limit(0), toxicity.NoisyOr(np.zeros(toxicity.BUCKETS), -3.0)).count() == 0
    assert quality.features("a1" * 9 + "x")[1] != quality.features("a1" * 9 + "!")[1]
