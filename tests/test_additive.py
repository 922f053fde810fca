"""Additive models against brute force on the rows themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainfit.operators import additive
from plainfit.plans.bins import binned, edges_of


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=3000), rng.integers(0, 5, 3000).astype(float), np.ones(3000)
    y = np.where(a > 0.2, 3.0, 0.0) + 2.0 * b + rng.normal(size=3000) * 0.1
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(a, b, c, y, strict=True))]
    df = spark.createDataFrame([*rows, (9000, None, 1.0, 1.0, 2.0), (9001, math.nan, 1.0, 1.0, 2.0)], "id long, a double, b double, c double, y double").repartition(4)
    return df.cache(), a, b, c, y


def test_binned_moments_equal_counts_on_the_rows(data):
    df, a, b, c, y = data
    edges = edges_of(df.filter("not isnan(a)"), ["a", "b", "c"], 8)
    assert edges[2] == [] and len(edges[0]) == 7 and edges[1] == [0.0, 1.0, 2.0, 3.0]
    found = binned(df, ["a", "b", "c"], F.col("y"), edges)[0]
    hot = np.zeros((3000, sum(len(e) + 1 for e in edges)))
    for x, e, at in zip((a, b, c), edges, found.cells, strict=True):
        hot[np.arange(3000), at.start + np.array([sum(v > k for k in e) for v in x])] = 1
    assert np.allclose(found.meet, hot.T @ hot) and np.allclose(found.labels, hot.T @ y)
    f = np.random.default_rng(0).normal(size=hot.shape[1])
    assert math.isclose(found.sse(f, 0.7), ((y - 0.7 - hot @ f) ** 2).sum(), rel_tol=1e-9)


def test_backfitting_reaches_least_squares_on_the_bins(data):
    df, a, b, c, y = data
    df = df.filter("not isnan(a)")
    model = additive.bin_gam(df, ["a", "b", "c"], F.col("y"), bins=8)
    edges = edges_of(df, ["a", "b", "c"], 8)
    hot = np.stack([np.ones(3000), *(x > k for x, e in zip((a, b, c), edges, strict=True) for k in e)], 1).astype(float)
    want = hot @ np.linalg.lstsq(hot, y, rcond=None)[0]
    got = np.array([r.pred for r in model.transform(df).filter("id < 9000").orderBy("id").select("pred").collect()])
    assert np.abs(got - want).max() < 1e-6


@pytest.mark.parametrize("cyclic", [False, True])
def test_stumps_find_steps_and_lines(data, cyclic):
    df = data[0].filter("not isnan(a)")
    model = additive.stump_gam(df, ["a", "b", "c"], F.col("y"), F.col("id") % 5 == 0, cyclic=cyclic, passes=0, straight=0.99)
    assert [t.kind for t in model.terms if t.a == "b"] == ["linear"] and not [t for t in model.terms if t.a == "c"]
    assert additive.error_of(model, df.filter("id < 9000"), F.col("y")).first().r2 > 0.98
    assert additive.stump_gam(df.limit(0), ["a"], F.col("y"), F.lit(False)).terms == []


def test_hinges_and_searched_terms(data, spark):
    rng = np.random.default_rng(5)
    x, z = rng.uniform(-1, 1, 2000), rng.uniform(-1, 1, 2000)
    y = 2 * np.maximum(0, x) + z + 0.01 * rng.normal(size=2000)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x, z, y, strict=True))], "id long, x double, z double, y double")
    lasso = additive.hinge_lasso(df, ["x", "z"], F.col("y"), F.col("id") % 3)
    short = additive.symbolic(df, ["x", "z"], F.col("y"), F.col("id") % 4 == 0)
    for model in (lasso, short):
        assert additive.error_of(model, df, F.col("y")).first().r2 > 0.995
    assert {t.a for t in short.terms} == {"x", "z"} and len(short.terms) <= 4
