"""Trees, teachers and the evaluation grid."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainfit.operators import teacher, tree
from plainfit.operators.model import Term, TermModel


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 10, 800).astype(float), rng.integers(0, 10, 800).astype(float)
    y = np.where(a > 4, 10.0, 0.0) + np.where((a > 4) & (b > 2), 4.0, 0.0) + rng.normal(size=800) * 0.1
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(a, b, y, strict=True))]
    return spark.createDataFrame([*rows, (9000, None, 1.0, 3.0)], "id long, a double, b double, y double").cache()


def test_tree_finds_the_regions_and_its_forms_agree(data):
    t = tree.fit_tree(data, ["a", "b"], F.col("y"), max_depth=4, max_leaves=3)
    assert len(t.leaves()) == 3 and {t.nodes[i].feature for i in t._inner()} == {"a", "b"}
    rules = t.rules()
    got = t.transform(data).withColumn("list", tree.decision_list(rules, -1.0)).filter("a is not null").collect()
    assert all(r.pred == r.list for r in got) and sum(r.n for r in rules) == 800
    want = {}
    for r in got:
        want.setdefault((r.a > 4, r.a > 4 and r.b > 2), []).append(r.y)
    assert sorted(x.value for x in rules) == pytest.approx(sorted(np.mean(v) for v in want.values()))
    assert t.transform(data).filter("id = 9000").first().pred is not None  # nulls go to the right


def test_shrinking_recalibrating_and_pruning(data):
    t = tree.fit_tree(data, ["a", "b"], F.col("y"), max_depth=3, max_leaves=3)
    assert {i: n.value for i, n in tree.shrink(t, 0.0).nodes.items() if i in t.leaves()} == pytest.approx({i: t.nodes[i].value for i in t.leaves()})
    root, left = t.nodes[0], t.nodes[t.nodes[0].left]
    assert math.isclose(tree.shrink(t, 100.0).nodes[root.left].value, root.value + (left.value - root.value) / (1 + 100 / root.n))
    again = tree.recalibrate(t, data.filter("a is not null"), F.col("y") + 1)
    assert all(math.isclose(again.nodes[i].value, t.nodes[i].value + 1) for i in t.leaves())
    assert len(tree.prune_ccp(t, 1e9).leaves()) == 1 and len(tree.prune_ccp(t, 0.0).leaves()) == 3
    assert tree.fit_tree(data.limit(0), ["a"], F.col("y")).leaves() == [0]


def test_corrector_has_a_gate(data):
    df = data.filter("a is not null")
    mean = TermModel([], 8.0)
    open_ = teacher.with_corrector(mean, df, ["a", "b"], F.col("y"), trees=5)
    exact = TermModel([Term("step", "a", 13.0, knot=4.5)], 0.0)
    assert open_.corrector is not None and teacher.with_corrector(exact, df, ["a", "b"], F.col("y"), gate=0.5).corrector is None
    grid = teacher.evaluate({"corrected": lambda d: open_, "mean": lambda d: mean, "broken": lambda d: 1 / 0}, {"d": (df, df)}, "y")
    rmse = {r.model: r for r in grid.collect()}
    assert rmse["corrected"].rmse < 0.2 * rmse["mean"].rmse and rmse["broken"].rmse is None and "ZeroDivisionError" in rmse["broken"].error
    folds = teacher.cross_validated_error(df, lambda d: exact, F.col("y"), F.col("id") % 3, 3).collect()
    assert sum(r.n for r in folds) == 800


def test_blend_weights_are_the_best_mix(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(size=500) + 50
    p = np.stack([y + rng.normal(size=500), y + 2 * rng.normal(size=500), y + 5], 1)
    df = spark.createDataFrame([tuple(map(float, (*r, v))) for r, v in zip(p, y, strict=True)], "p double, q double, r double, y double")
    w = np.array(teacher.blend_weights(df, ["p", "q", "r"], F.col("y")))
    best = min(((np.square(p @ np.array([i, j, 100 - i - j]) / 100 - y).mean()), i / 100, j / 100) for i in range(101) for j in range(101 - i))
    assert math.isclose(w.sum(), 1) and w.min() >= 0 and np.square(p @ w - y).mean() <= best[0] + 1e-9
    assert teacher.blend_weights(df.limit(0), ["p", "q"], F.col("y")) == [0.5, 0.5]
