"""Distillation over folds: a surface with all rows of each fold, noise from hashes, and students that are labelled again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainfit.operators import tree as R


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(5)
    x, z = rng.uniform(0, 10, 600), rng.uniform(0, 1, 600)
    y = np.where(x > 4, 3.0, 0.0) + np.where(z > 0.5, 1.0, 0.0) + rng.normal(0, 0.2, 600)
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))] + [(900, None, 0.5, 1.0)], "i int, x double, z double, y double").cache()


def test_noise_is_normal_and_the_same_in_any_order(df):
    whole = df.filter("x is not null")
    once = {(r.i, r["__copy"]): (r.x, r.z) for r in R.noisy_copies(whole, ["x", "z"], ["i"], 3, 0.5).collect()}
    again = {(r.i, r["__copy"]): (r.x, r.z) for r in R.noisy_copies(whole.repartition(5, "z"), ["x", "z"], ["i"], 3, 0.5).collect()}
    assert len(once) == 2400 and all(np.allclose(once[k], again[k]) for k in once)
    base = {r.i: (r.x, r.z) for r in whole.collect()}
    assert all(v == base[i] for (i, copy), v in once.items() if copy == 0)
    spread = np.std([r.x for r in whole.collect()])
    gaps = np.array([v[0] - base[i][0] for (i, copy), v in once.items() if copy]) / spread
    assert abs(gaps.mean()) < 0.05 and abs(gaps.std() - 0.5) < 0.03


def test_surface_and_tree(df):
    options = {"leaves": (2, 4), "strengths": (0.0, 20.0), "depth": 3, "trees": 3}
    for more in ({}, {"copies": 1, "rounds": 2}):
        tree, surface = R.distilled_by_folds(df, ["x", "z"], F.col("y"), F.col("i") % 3, 3, ["i"], **options, **more)
        found = surface.collect()
        assert len(found) == 3 * 4 and {(r.leaves, r.strength) for r in found} == {(n, s) for n in (2, 4) for s in (0.0, 20.0)}
        assert all(r.n == 200 for r in found)
        error = {k: np.sqrt(np.mean([r.rmse**2 for r in found if (r.leaves, r.strength) == k])) for k in {(r.leaves, r.strength) for r in found}}
        assert min(error, key=error.get)[0] == 4 and error[4, 0.0] < error[2, 0.0]
        got = tree.transform(df.filter("x is not null")).toPandas()
        assert len(tree.leaves()) == 4 and np.sqrt(np.mean((got.pred - got.y) ** 2)) < 0.4
