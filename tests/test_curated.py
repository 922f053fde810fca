"""The ten named models on the smoke data, and what they print against what they score."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plainfit.operators import additive as G
from plainfit.operators import curated
from plainfit.operators import teacher as E
from plainfit.operators import tree as R
from plainfit.operators.model import Term, TermModel, effect_curve, effect_slope, permutation_importance, probe, toggle_effect

COLS = [f"x{i}" for i in range(6)]
FEW = {"dual_path_sparse_symbolic": {"trees": 3}, "teacher_student_rule_spline": {"trees": 5}, "distilled_tree_blend_atlas": {"trees": 3}, "hybrid_gam": {"trees": 10}}


def smoke(seed=0, n=240):
    """Four informative of six normal columns, noise 0.3."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    return x, x @ np.array([40.0, 0.0, 25.0, -60.0, 0.0, 10.0]) + rng.normal(size=n) * 0.3


@pytest.fixture(scope="module")
def rows(spark):
    x, y = smoke()
    data = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, x0 double, x1 double, x2 double, x3 double, x4 double, x5 double, y double").repartition(3).cache()


def r2(model, df):
    return model.transform(df).agg((1 - F.avg(F.pow(F.col("y") - F.col("pred"), 2)) / F.var_pop("y")).alias("r2")).first().r2


@pytest.mark.parametrize("name", list(curated.MODELS))
def test_every_named_model_fits_predicts_and_prints(rows, name):
    train, test = rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0")
    model = curated.MODELS[name](train, COLS, F.col("y"), ["id"], **FEW.get(name, {}))
    floor = {"tiny_tree": 0.3, "smart_additive": 0.75, "teacher_student_rule_spline": 0.15, "dual_path_sparse_symbolic": 0.6, "distilled_tree_blend_atlas": 0.6}.get(name, 0.9)
    assert r2(model, test) > floor
    card = model.card()
    assert card and "x3" in card and len(card.splitlines()) < 120
    if isinstance(model, E.DualPath):
        assert model.transform(test, mode="symbolic").filter("pred is null").count() == 0
        assert r2(model.symbolic, test) > 0.9
    if name in curated.HONEST:
        pred = {r.id: r.pred for r in model.transform(test).select("id", "pred").collect()}
        con = duckdb.connect()
        con.register("t", test.toPandas())
        sql = dict(con.sql(f"SELECT id, {model.sql()} FROM t").fetchall())
        assert all(sql[i] == pytest.approx(p, abs=1e-8) for i, p in pred.items())


def test_cards_give_the_prediction_by_hand():
    shape = G.ShapeModel([Term("step", "a", 2.0, knot=1.0), Term("step", "a", -1.0, knot=3.0), Term("linear", "b", 0.5)], 10.0)
    lines = shape.card().splitlines()
    assert lines[0].startswith("y = 11") and "+0.5 * b" in lines[0] and "f(a)" in lines[0]
    assert [line.split(": ")[1] for line in lines[2:]] == ["-1", "+1", "+0"]
    bent = G.PiecewiseModel([Term("linear", "a", 1.0), Term("hinge", "a", 2.0, knot=5.0), Term("hinge", "a", 3.0, knot=2.0, direction=-1)], 0.0)
    assert bent.segments("a") == [(None, 2.0, -2.0, 6.0), (2.0, 5.0, 1.0, 0.0), (5.0, None, 3.0, -10.0)]
    model = TermModel([Term("interact", "a", -4.0, "b"), Term("linear", "a", 2.0), Term("linear", "c", 0.0)], 0.0)
    assert model.ranking(["d"]) == [("a", pytest.approx(4 / 6)), ("b", pytest.approx(2 / 6)), ("c", 0.0), ("d", 0.0)]
    assert model.columns() == ["a", "b"] and model.operations() == 7


def test_new_terms_score_as_their_sql_says(spark):
    terms = [Term("clipped", "a", 2.0, knot=-1.0, high=1.0), Term("interact", "a", 1.0, "b", knot=0.5, high=-0.5), Term("sin", "a", 1.0), Term("decay", "b", 3.0), Term("kink", "b", 1e-7, knot=1e20)]
    model = TermModel(terms, 1.5)
    df = spark.createDataFrame([(float(a), float(b)) for a in (-3, 0, 0.25, 5) for b in (-1, 0, 2)], "a double, b double")
    got = [tuple(r) for r in model.transform(df).collect()]
    con = duckdb.connect()
    con.register("t", df.toPandas())
    want = {(a, b): p for a, b, p in con.sql(f"SELECT a, b, {model.sql()} FROM t").fetchall()}
    assert all(want[a, b] == pytest.approx(p, rel=1e-12) for a, b, p in got)


@pytest.fixture(scope="module")
def curve(spark):
    """3 max(0, a) + 2 sin(b) + c with a step in d."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4))
    y = 3 * np.maximum(0, x[:, 0]) + 2 * np.sin(x[:, 1]) + x[:, 2] + 2 * (x[:, 3] > 0.5) + rng.normal(size=900) * 0.1
    data = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, y double").repartition(3).cache()


ABCD = list("abcd")


def Y():
    return F.col("y")


def HELD():
    return F.col("id") % 5 == 0


def FOLD():
    return F.col("id") % 3


@pytest.mark.parametrize(
    ("fit", "floor"),
    [
        (lambda d: G.hinge_gam(d, ABCD, Y(), FOLD()), 0.9), (lambda d: G.piecewise_gam(d, ABCD, Y(), FOLD(), interactions=1), 0.9), (lambda d: G.basis_pursuit(d, ABCD, Y(), HELD()), 0.9),
        (lambda d: G.bin_ridge_gam(d, ABCD, Y()), 0.9), (lambda d: G.shape_trees(d, ABCD, Y(), HELD()), 0.93), (lambda d: G.trunk_plus_terms(d, ABCD, Y(), HELD()), 0.88),
        (lambda d: G.calibrated_score(d, ABCD, Y(), HELD()), 0.7), (lambda d: G.split_linear(d, ABCD, Y(), HELD()), 0.85), (lambda d: G.one_knot_additive(d, ABCD, Y(), HELD()), 0.93),
        (lambda d: G.boosted_hinges(d, ABCD, Y(), HELD()), 0.9), (lambda d: G.spline_gam(d, ABCD, Y(), FOLD()), 0.9), (lambda d: G.gbt_shapes(d, ABCD, Y(), 15, 0.5), 0.8),
        (lambda d: G.fourier_ridge(d, ABCD, Y(), FOLD(), 24, 0.1), 0.6), (lambda d: G.stump_gam(d, ABCD, Y(), HELD(), leaf_l2=1.0, max_splits=8, share=0.5, fits=2), 0.7),
        (lambda d: G.symbolic(d, ABCD, Y(), HELD(), kinds=("linear", "sin", "hinge", "step")), 0.97),
        (lambda d: R.model_tree(d, ABCD, Y()), 0.75), (lambda d: R.rule_lasso(d, ABCD, Y(), FOLD(), 4), 0.75), (lambda d: R.tree_guided_linear(d, ABCD, Y(), FOLD()), 0.85),
        (lambda d: R.folded_tree(d, ABCD, Y()), 0.3), (lambda d: R.augmented_tree(d, ABCD, Y()), 0.65), (lambda d: R.trunk_plus_stumps(d, ABCD, Y()), 0.88),
        (lambda d: R.prototypes(d, ABCD, Y(), 12), 0.3), (lambda d: R.mini_boost(d, ABCD, Y()), 0.6), (lambda d: R.best_of_bagged(d, ABCD, Y(), HELD(), 5), 0.3),
        (lambda d: R.distilled_tree(d, ABCD, Y(), HELD(), trees=3), 0.55),
    ],
)
def test_models_of_curved_data(curve, fit, floor):
    train, test = curve.filter("id % 4 <> 0"), curve.filter("id % 4 = 0")
    model = fit(train)
    assert r2(model, test) > floor
    assert isinstance(model, R.Tree | R.ModelTree | G.FourierModel) or model.card()
    if hasattr(model, "sql") and hasattr(model, "column"):
        pred = {r.id: r.pred for r in model.transform(test).select("id", "pred").collect()}
        con = duckdb.connect()
        con.register("t", test.toPandas())
        sql = dict(con.sql(f"SELECT id, {model.sql()} FROM t").fetchall())
        assert all(sql[i] == pytest.approx(p, abs=1e-8) for i, p in pred.items())


def test_an_ensemble_of_trees_is_sparks_own(spark, curve):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    data = VectorAssembler(inputCols=ABCD, outputCol="f").transform(curve)
    for kind, fit in (("gbt", GBTRegressor(featuresCol="f", labelCol="y", maxIter=4, maxDepth=3, stepSize=0.1, seed=42)), ("rf", RandomForestRegressor(featuresCol="f", labelCol="y", numTrees=4, maxDepth=3, seed=42))):
        trees, weights = R.ensemble(curve, ABCD, Y(), kind, 4, 3, 0.1)
        want = {r.id: r.prediction for r in fit.fit(data).transform(data).collect()}
        got = {r.id: r.pred for r in R.TreeSum(trees, weights).transform(curve).collect()}
        assert len(trees) == 4 and all(got[i] == pytest.approx(v, abs=1e-9) for i, v in want.items())


def test_bin_ridge_equals_ridge_on_indicators(curve):
    x = np.array([tuple(r) for r in curve.select("a", "b", "y").collect()])
    from plainfit.plans.bins import edges_of

    edges = edges_of(curve, ["a", "b"], 4)
    z = np.concatenate([np.eye(4)[np.searchsorted(e, x[:, i], side="left")] for i, e in enumerate(edges)], axis=1)
    zc, yc = z - z.mean(0), x[:, 2] - x[:, 2].mean()
    f = np.linalg.solve(zc.T @ zc + 2.0 * np.eye(8), zc.T @ yc)
    want = {(float(a), float(b)): v for (a, b, _), v in zip(x, zc @ f + x[:, 2].mean(), strict=True)}
    model = G.bin_ridge_gam(curve, ["a", "b"], Y(), 4, 2.0)
    assert all(r.pred == pytest.approx(want[r.a, r.b], abs=1e-8) for r in model.transform(curve).collect())


def test_teachers_choose_calibrate_and_distil(spark, curve):
    lines = lambda d: __import__("plainfit.operators.model", fromlist=["linear_model"]).linear_model(__import__("plainfit.operators.linear", fromlist=["ols"]).ols(__import__("plainfit.plans.gram", fromlist=["gram"]).gram(d, {c: F.col(c) for c in ABCD}, Y())[()]))
    name, model, errors = E.choose({"line": lines, "bent": lambda d: G.hinge_gam(d, ABCD, Y(), FOLD()), "tree": lambda d: R.fit_tree(d, ABCD, Y(), 2)}, curve, Y(), FOLD())
    found = {r.model: r.rmse for r in errors.collect()}
    assert name == "bent" and found["bent"] < found["line"] < found["tree"] and r2(model, curve) > 0.9
    off = TermModel([Term(t.kind, t.a, 0.5 * t.coef, t.b, t.knot, t.direction) for t in model.terms], model.intercept + 7)
    right = E.calibrate(off, curve, Y())
    assert right.slope == pytest.approx(2, abs=0.05) and r2(right, curve) > 0.9
    tree = R.fit_tree(curve, ABCD, Y(), 5)
    student = E.distil(curve, Y(), tree, lambda rows, target: G.hinge_gam(rows, ABCD, target, FOLD()), 0.5)
    assert r2(student, curve) > 0.85
    scored = tree.transform(off.transform(curve, "p1"), "p2")
    w = E.error_weights(scored, ["p1", "p2"], Y())
    assert sum(w) == pytest.approx(1) and w[1] > w[0]
    blend = E.teacher_blend(curve, ABCD, Y(), HELD(), trees=2)
    assert sum(blend.weights) == pytest.approx(1) and min(blend.weights) >= 0 and r2(blend, curve) > 0.6
    both = E.with_additive_corrector(lines(curve), curve, ABCD, Y(), HELD(), 0.01)
    assert both.corrector is not None and r2(both, curve) > r2(lines(curve), curve) and "corrector" in both.card()
    mixed = E.blended(F.col("y"), {"p1": 0.25, "p2": 0.75}, 0.5)
    assert scored.select((mixed - 0.5 * (0.25 * F.col("p1") + 0.75 * F.col("p2")) - 0.5 * F.col("y")).alias("d")).filter("abs(d) > 1e-9").count() == 0


def test_explanations(spark, curve):
    model = TermModel([Term("linear", "a", 2.0), Term("linear", "b", 0.0), Term("hinge", "c", 1.0, knot=0.0)], 1.0)
    rows = model.transform(curve, "y2")
    got = {r.column: r for r in permutation_importance(model, rows, ["a", "b", "c"], F.col("y2")).collect()}
    spread = rows.agg(F.stddev_pop("a")).first()[0]
    assert got["b"].increase == pytest.approx(0, abs=1e-9) and got["a"].increase > got["c"].increase > 0
    assert got["a"].rmse == pytest.approx(2 * 2**0.5 * spread, rel=0.1)
    line = effect_slope(effect_curve(model, curve, ["a", "b", "c"], "a"), "a").first()
    assert line.slope == pytest.approx(2) and line.r2 == pytest.approx(1)
    assert toggle_effect(model, curve, "a").first().effect == pytest.approx(2)
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 2.0)], "k int, a double, b double, c double")
    assert [(r.pred, r.difference) for r in probe(model, points, "k").collect()] == [(1.0, 0.0), (5.0, 4.0)]
