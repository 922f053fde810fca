"""Boosted trees and forests learn from distinct rows, however often each is repeated."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from plainfit.operators import teacher as E
from plainfit.plans.bins import edges_of

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """3600 rows of which about 300 differ in their columns; labels differ in all."""
    rng = np.random.default_rng(7)
    x = np.stack([rng.integers(0, 40, 300) / 4, rng.integers(0, 5, 300), rng.integers(0, 3, 300)], axis=1)[np.arange(3600) % 300]
    y = 5 * np.sin(x[:, 0]) + x[:, 1] ** 2 + 3 * x[:, 2] + rng.normal(size=3600)
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double").repartition(3).cache()


def r2(rows, pred):
    return rows.agg((1 - F.avg(F.pow(F.col("y") - F.col(pred), 2)) / F.var_pop("y")).alias("r2")).first().r2


def test_boosted_trees_read_distinct_rows_and_are_sparks_own(rows, monkeypatch):
    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data: seen.append(data.count()) or fit(self, data))
    mine = E.teacher(rows, COLS, F.col("y"), "gbt", 6, 3)
    assert seen == [rows.select(*COLS).distinct().count()]
    data = VectorAssembler(inputCols=COLS, outputCol="f").transform(rows)
    both = fit(GBTRegressor(featuresCol="f", labelCol="y", maxIter=6, maxDepth=3, stepSize=0.1, seed=42), data).transform(mine.transform(data))
    assert both.filter("abs(pred - prediction) > 1e-9").count() == 0


def test_a_forest_reads_few_rows_and_is_as_good_as_sparks(rows, monkeypatch):
    from plainfit.operators import forest as R

    seen, drawn = [], R._drawn
    monkeypatch.setattr(R, "_drawn", lambda *args: seen.append(drawn(*args)) or seen[-1])
    mine = E.teacher(rows, COLS, F.col("y"), "rf", 30, 6)
    distinct = rows.select(*COLS).distinct().count()
    assert len(seen) == 2 and all(t.count() <= rows.rdd.getNumPartitions() * distinct for t in seen)
    # Each tree draws about as many rows as there are, and no two the same.
    totals = [v for t in seen for v in t.select(F.posexplode("w").alias("t", "w")).groupBy("t").agg(F.sum("w")).toPandas().iloc[:, 1]]
    assert len(set(totals)) > 20 and all(abs(v - 3600) < 6 * 60 for v in totals)
    data = VectorAssembler(inputCols=COLS, outputCol="f").transform(rows)
    both = RandomForestRegressor(featuresCol="f", labelCol="y", numTrees=30, maxDepth=6, seed=42).fit(data).transform(mine.transform(data))
    assert r2(both, "pred") == pytest.approx(r2(both, "prediction"), abs=0.05)
    odd = rows.limit(1).select(F.lit(None).cast("double").alias("a"), "b", "c").unionByName(rows.limit(1).select(*COLS))
    assert [r.pred is None for r in mine.transform(odd).collect()] == [True, False]


def test_trees_are_grown_as_by_hand(rows):
    from plainfit.operators import forest as R

    edges = R.cuts_of(rows, COLS)
    assert edges[1:] == [[0.0, 1.0, 2.0, 3.0], [0.0, 1.0]] and len(edges[0]) <= 31
    drawn = R._drawn(rows, edges, 0.0, 2, 1)
    x, w, s = (np.array(v, dtype=float) for v in zip(*drawn.collect(), strict=True))
    column, cut, left, value = R._grown(drawn, 3, 2, 2, 3, np.random.default_rng(0))

    def grow(at, t, depth):
        """Values of the leaves from left to right."""
        n, y = w[at, t], s[at, t]
        gain = lambda go: y[go].sum() ** 2 / n[go].sum() + y[~go].sum() ** 2 / n[~go].sum() if 0 < n[go].sum() < n.sum() else -1
        go = max((x[at, j] <= k for j in range(3) for k in range(32)), key=gain)
        return [y.sum() / n.sum()] if not depth or gain(go) < 0 else grow(at[go], t, depth - 1) + grow(at[~go], t, depth - 1)

    def leaves(k):
        return [value[k]] if column[k] < 0 else leaves(left[k]) + leaves(left[k] + 1)

    for t in range(2):
        assert leaves(t) == pytest.approx(grow(np.arange(len(x)), t, 2))


def test_cuts_by_counts_and_by_quantiles_agree(spark, monkeypatch):
    from plainfit.operators import forest as R

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(i), float(v), 1.0) for i, v in enumerate(rng.integers(0, 90, 2000))], "a double, b double, c double").repartition(3)
    found = R.cuts_of(df, COLS)
    assert found[1] == edges_of(df, ["b"], 32)[0] and len(found[0]) == 31 and found[2] == []
    monkeypatch.setattr(R, "FEW", 0)
    assert R.cuts_of(df, COLS) == found


def test_a_forest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, y double")
    assert E.teacher(one, COLS, F.col("y"), "rf", 3).transform(one).first().pred == 4.0
    with pytest.raises(ValueError):
        E.teacher(one.limit(0), COLS, F.col("y"), "rf", 3)
