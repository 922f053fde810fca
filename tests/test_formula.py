"""Formulas give the coefficients of designs made by hand, and the registered closed forms equal their SQL."""

import glob
import os
from math import comb, isclose

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plainfit import registry_wide
from plainfit.operators import formula as S
from plainfit.operators import glm as M
from plainfit.operators import inference as H

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for i in range(400):
        a, z, g, h, b = rng.normal(), rng.uniform(0, 5), "pqr"[rng.integers(3)], "uv"[rng.integers(2)], bool(rng.integers(2))
        out.append((i % 23, float(a), float(z), g, h, b, float(2 + a * (1 + (g == "q")) - 3 * (h == "v") + np.log1p(z) + rng.normal())))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    more = [(1, None, 1.0, "p", "u", True, None), (2, 1.0, 1.0, None, "v", False, None), (3, 0.5, 2.0, "q", "u", True, None)]
    return spark.createDataFrame(rows + more, "who int, a double, z double, g string, h string, b boolean, y double").cache()


def one(rows, f):
    return np.array([float(f(dict(zip(("who", "a", "z", "g", "h", "b", "y"), r, strict=True)))) for r in rows])


DESIGNS = {
    "y ~ a": [lambda r: 1, lambda r: r["a"]],
    "y ~ a - 1": [lambda r: r["a"]],
    "y ~ 0 + g": [lambda r, k=k: r["g"] == k for k in "pqr"],
    "y ~ g + h": [lambda r: 1, lambda r: r["g"] == "q", lambda r: r["g"] == "r", lambda r: r["h"] == "v"],
    "y ~ g - 1 + h": [*(lambda r, k=k: r["g"] == k for k in "pqr"), lambda r: r["h"] == "v"],
    "y ~ a * C(g, Treatment('r'))": [lambda r: 1, lambda r: r["g"] == "p", lambda r: r["g"] == "q", lambda r: r["a"], lambda r: r["a"] * (r["g"] == "p"), lambda r: r["a"] * (r["g"] == "q")],
    "y ~ C(g, Sum)": [lambda r: 1, lambda r: (r["g"] == "p") - (r["g"] == "r"), lambda r: (r["g"] == "q") - (r["g"] == "r")],
    "y ~ np.log1p(z) + I(a ** 2 + z) + b": [lambda r: 1, lambda r: r["b"], lambda r: np.log1p(r["z"]), lambda r: r["a"] ** 2 + r["z"]],
    "y ~ g / a": [lambda r: 1, lambda r: r["g"] == "q", lambda r: r["g"] == "r", *(lambda r, k=k: r["a"] * (r["g"] == k) for k in "pqr")],
    "y ~ (a + z + h) ** 2 - a:z": [lambda r: 1, lambda r: r["h"] == "v", lambda r: r["a"], lambda r: r["a"] * (r["h"] == "v"), lambda r: r["z"], lambda r: r["z"] * (r["h"] == "v")],
    "y ~ g:h": [lambda r: 1, lambda r: r["h"] == "v", *(lambda r, k=k, j=j: (r["g"] == k) * (r["h"] == j) for k in "qr" for j in "uv")],
    "np.sqrt(z) ~ Q('a') + C(who > 11)": [lambda r: 1, lambda r: r["who"] > 11, lambda r: r["a"]],
    "y ~ C(b):a + np.maximum(a, 0)": [lambda r: 1, lambda r: (not r["b"]) * r["a"], lambda r: r["b"] * r["a"], lambda r: max(r["a"], 0)],
}


@pytest.mark.parametrize("formula", DESIGNS)
def test_coefficients_equal_designs_by_hand(df, rows, formula):
    x = np.stack([one(rows, f) for f in DESIGNS[formula]], axis=1)
    y = one(rows, (lambda r: np.sqrt(r["z"])) if "sqrt" in formula else (lambda r: r["y"]))
    if "sqrt" in formula:  # rows without y are complete there
        x, y = np.vstack([x, [1, 0, 1.0], [1, 0, 0.5]]), np.append(y, np.sqrt([1.0, 2.0]))
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    found = S.ols(df, formula)[0]
    assert len(found) == len(want)
    assert np.allclose([r[1] for r in found], want, atol=1e-6)
    e = y - x @ want
    assert np.allclose([r[2] for r in found], np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(y) - len(want))), rtol=1e-6)


def test_names_levels_and_faults(df):
    d = S.design(df, "y ~ a:C(g, Treatment(reference='q')) + standardize(z)")
    assert d.intercept and list(d.terms) == ["a:C(g, Treatment(reference='q'))", "standardize(z)"]
    assert list(d.columns)[:3] == [f"a:C(g, Treatment(reference='q'))[{k}]" for k in "pqr"]
    z = df.select(d.columns["standardize(z)"].alias("z")).agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(z[0]) < 1e-12 and isclose(z[1], 1.0)
    for wrong in ("y", "y ~", "~ a", "y ~ a % z", "y ~ open('x')", "y ~ C(g, Poly)", "y ~ C(g, Treatment('zz'))", "y ~ a ** z"):
        with pytest.raises((ValueError, SyntaxError)):
            S.design(df, wrong)


def test_dependent_columns_share_their_effect(df):
    single, double = S.ols(df, "y ~ a")[0], S.ols(df, "y ~ a + I(2 * a)")[0]
    assert isclose(double[1][1] + 2 * double[2][1], single[1][1], rel_tol=1e-9)
    assert isclose(double[0][2], single[0][2], rel_tol=1e-9)


def test_rows_with_a_null_in_the_formula_are_left_out(df, rows):
    more = df.union(df.limit(1).select("who", F.lit(None).cast("double"), "z", F.lit(None).cast("string"), "h", "b", F.lit(1e6)))
    for formula in ("y ~ g", "y ~ a", "y ~ a:g + z"):
        assert np.allclose([r[1] for r in S.ols(more, formula)[0]], [r[1] for r in S.ols(df, formula)[0]])


def test_robust_errors_without_intercept(df, rows):
    x, y, who = np.stack([one(rows, lambda r, k=k: r["g"] == k) for k in "pqr"], axis=1), one(rows, lambda r: r["y"]), one(rows, lambda r: r["who"])
    inv = np.linalg.inv(x.T @ x)
    e = y - x @ (inv @ x.T @ y)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    hc3 = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    assert np.allclose([r[2] for r in S.ols(df, "y ~ g - 1", "HC3")[0]], np.sqrt(np.diag(hc3)))
    scores = np.stack([(x * e[:, None])[who == w].sum(axis=0) for w in np.unique(who)])
    v = inv @ scores.T @ scores @ inv * (len(scores) / (len(scores) - 1) * (len(y) - 1) / (len(y) - 3))
    assert np.allclose([r[2] for r in S.ols(df, "y ~ g - 1", "cluster", "who")[0]], np.sqrt(np.diag(v)))


def test_formula_of_generalised_models(df):
    effects = S.glm(df, "b ~ a * h", "binomial")
    assert [e.name for e in effects] == ["intercept", "h[T.v]", "a", "a:h[T.v]"]


@pytest.mark.parametrize(("a", "b"), [(1, 1), (3, 4), (5, 5), (2, 40), (8, 11)])
def test_rank_sum_null_equals_enumeration(a, b):
    counts = np.zeros((a + 1, a * b + a * (a + 1) // 2 + a + b + 1))
    counts[0, 0] = 1
    for r in range(1, a + b + 1):  # subsets by size and sum
        for k in range(a, 0, -1):
            counts[k, r:] += counts[k - 1, :-r]
    low = a * (a + 1) // 2
    assert np.allclose(H.rank_sum_null(a, b), counts[a, low : low + a * b + 1] / comb(a + b, a), atol=1e-14)


def test_signed_rank_null_equals_enumeration():
    sums = np.zeros(8 * 9 // 2 + 1)
    for mask in range(256):
        sums[sum(i + 1 for i in range(8) if mask >> i & 1)] += 1 / 256
    assert np.allclose(H.signed_rank_null(8), sums)
    assert isclose(H.signed_rank_null(50).sum(), 1.0)


def test_rank_tests_choose_their_null(spark):
    small = spark.createDataFrame([("a", float(v)) for v in (1.0, 4.5, 6.0)] + [("b", float(v)) for v in (2.0, 7.0, 8.0, 9.5)], "c string, v double")
    assert isclose(H.mann_whitney(small, "v", "c", "a", "b").p, 2 * 4 / 35)  # U = 2: 4 of 35 orders are as low
    assert isclose(H.mann_whitney(small, "v", "c", "a", "b", "less").p, 4 / 35)
    tied = small.union(spark.createDataFrame([("b", 1.0)], "c string, v double"))
    assert H.mann_whitney(tied, "v", "c", "a", "b").p == H.mann_whitney(tied, "v", "c", "a", "b", method="normal").p
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (-4.0,), (None,)], "d double")
    assert isclose(H.wilcoxon(d, F.col("d")).p, 14 / 16)
    assert H.wilcoxon(d.union(spark.createDataFrame([(0.0,)], "d double")), F.col("d")).df == 4


def test_negative_binomial_likelihood(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=4000)
    y = rng.negative_binomial(2.0, 2.0 / (2.0 + np.exp(0.5 + 0.7 * x)))
    df = spark.createDataFrame(list(zip(map(float, x), map(int, y), strict=True)), "x double, y int")
    fit = M.negbin_ml(df, F.col("y"), {"x": F.col("x")})
    assert abs(fit.dispersion - 0.5) < 4 * fit.dispersion_se and fit.dispersion_se < 0.05
    assert abs(fit.effects[0].coef - 0.5) < 0.1 and abs(fit.effects[1].coef - 0.7) < 0.1

    def likelihood(b0, b1, a):
        from math import lgamma, log

        r, mu = 1 / a, np.exp(b0 + b1 * x)
        gamma = {int(v): lgamma(v + r) - lgamma(r) - lgamma(v + 1) for v in set(y.tolist())}
        return sum(gamma[int(v)] + v * log(m / (r + m)) - r * np.log1p(a * m) for v, m in zip(y.tolist(), mu.tolist(), strict=True))

    at = [fit.effects[0].coef, fit.effects[1].coef, fit.dispersion]
    best = likelihood(*at)
    assert isclose(best, fit.log_likelihood, rel_tol=1e-9)
    errors = [fit.effects[0].se, fit.effects[1].se, fit.dispersion_se]
    for k in range(3):  # the top in every direction, and about half lower one error away
        for sign in (-1, 1):
            moved = [v + sign * e * (i == k) * 0.05 for i, (v, e) in enumerate(zip(at, errors, strict=True))]
            assert likelihood(*moved) < best
    even = spark.createDataFrame([(float(i % 2), 3) for i in range(100)], "x double, y int")
    flat = M.negbin_ml(even, F.col("y"), {"x": F.col("x")})
    assert flat.dispersion == 0.0 and flat.dispersion_se is None


CLOSED = [n for n, f in registry_wide.QUERIES.items() if f.__module__ in ("plainfit.registry_closed", "plainfit.registry_wide") and n in registry_wide.ORACLES]


@pytest.mark.parametrize("name", CLOSED)
def test_closed_forms_equal_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(registry_wide.ORACLES[name])
    got = registry_wide.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    mine = sorted(map(tuple, got.select(columns).collect()), key=repr)
    theirs = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or (isinstance(x, float) and y is not None and isclose(x, float(y), rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b, strict=True)), (a, b)
