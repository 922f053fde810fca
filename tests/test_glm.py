"""Generalised linear models and running totals against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from plainfit.operators import glm, inference
from plainfit.plans.order import running, value_ranks


def test_running_totals_equal_cumulative_sums(spark):
    rng = np.random.default_rng(0)
    keys = rng.permutation(2000)[:1500].tolist()
    values = {k: int(rng.integers(1, 9)) for k in keys}
    df = spark.createDataFrame([(k, v) for k, v in values.items()], "k long, v long").repartition(5)
    total = {r.k: r.t for r in running(df, "k", "v", "t").collect()}
    top = {r.k: r.t for r in running(df, "k", "v", "t", "max").collect()}
    before = 0
    for i, k in enumerate(sorted(keys)):
        assert total[k] == before and top[k] == (max(values[x] for x in sorted(keys)[:i]) if i else None)
        before += values[k]
    assert running(df.limit(0), "k", "v", "t").count() == 0


def test_ranks_of_strings_and_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("é",)], "s string")
    assert sorted((r.s, r.rank) for r in value_ranks(df, "s").collect()) == [("a", 1.0), ("b", 2.5), ("é", 4.0)]


def test_spearman_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (2, 5.0), (3, 4.0), (None, 9.0), (5, None)], "x int, y double")
    a, b = np.array([1, 2.5, 2.5, 4]), np.array([1.5, 1.5, 4, 3])
    assert math.isclose(inference.spearman(df, "x", "y").statistic, np.corrcoef(a, b)[0, 1])


def test_poisson_with_offset_finds_the_rate(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(e), int(rng.poisson(e * math.exp(0.3 + 0.5 * x)))) for x, e in zip(rng.normal(size=3000), rng.uniform(1, 5, 3000), strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 3)], "x double, e double, y int")
    start, slope = glm.glm(df, F.col("y"), {"x": F.col("x")}, "poisson", offset=F.log("e"))
    assert abs(start.coef - 0.3) < 4 * start.se and abs(slope.coef - 0.5) < 4 * slope.se and slope.p < 1e-9
    x, e, y = np.array(rows).T
    score = (y - e * np.exp(start.coef + slope.coef * x)) @ np.stack([np.ones(len(x)), x], 1)
    assert np.abs(score).max() < 1e-3 * len(x)


def test_negative_binomial_finds_coefficients_and_dispersion(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    mu = np.exp(1.0 + 0.4 * x)
    y = rng.poisson(mu * rng.gamma(2.0, 0.5, 4000))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "x double, y int")
    (start, slope), a = glm.negbin(df, F.col("y"), {"x": F.col("x")})
    assert abs(start.coef - 1) < 4 * start.se and abs(slope.coef - 0.4) < 4 * slope.se and abs(a - 0.5) < 0.1
    m = np.exp(start.coef + slope.coef * x)
    assert np.abs(((y - m) / (1 + a * m)) @ np.stack([np.ones(4000), x], 1)).max() < 0.05
    assert math.isclose(((y - m) ** 2 / (m + a * m**2)).sum(), 3998, rel_tol=1e-3)
