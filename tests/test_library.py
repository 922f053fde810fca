"""Algebra and reference values of the library proper."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainfit.functions import dist
from plainfit.operators import aggregate as A
from plainfit.operators import board as B
from plainfit.operators import inference as H
from plainfit.operators import linear as L
from plainfit.operators import prep as P
from plainfit.operators.model import Term, TermModel, effect_curve, honesty, linear_model, toggle_effect
from plainfit.plans import gram as G
from plainfit.sources import tables as S
from plainfit.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)) * [1, 3, 0.5, 1] + [10, 0, 1000, 0]
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * x[:, 2] + rng.normal(size=400) * (1 + abs(x[:, 3]))
    rows = [(i, i % 5, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, fold int, a double, b double, c double, d double, y double").repartition(3)


@pytest.fixture(scope="module")
def cols(spark):
    return {c: F.col(c) for c in "abcd"}


def test_both_moment_paths_agree_and_solve_least_squares(data, cols, monkeypatch):
    x, y, df = data
    plain = G.gram(df, cols, F.col("y"), ["fold"])
    monkeypatch.setattr(G, "MOST_PLAIN", 0)
    arrow = G.gram(df, cols, F.col("y"), ["fold"])
    for k in plain:
        assert np.allclose(plain[k].matrix, arrow[k].matrix, rtol=1e-9, atol=1e-7)
    e = L.ols(sum(list(plain.values())[1:], start=next(iter(plain.values()))))
    want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    assert np.allclose([e.intercept, *e.coef], want)


def test_cross_validation_from_moments_equals_refits(data, cols):
    x, y, df = data
    folds = G.gram(df, cols, F.col("y"), ["fold"])
    fold, error = np.arange(400) % 5, 0.0
    for k in range(5):
        z = np.column_stack([np.ones(400), x])
        b = np.linalg.lstsq(z[fold != k], y[fold != k], rcond=None)[0]
        error += ((y - z @ b)[fold == k] ** 2).sum()
    assert L.cross_validated(folds, L.ols) == pytest.approx(error / 400)
    fit, alpha = L.lasso_cv(folds)
    assert alpha > 0 and abs(fit.coef[3]) < 0.3 and fit.coef[0] == pytest.approx(2, abs=0.3)


def test_penalised_fits(data, cols):
    x, y, df = data
    m = G.gram(df, cols, F.col("y"))[()]
    z, v = x - x.mean(0), y - y.mean()
    assert np.allclose(L.ridge(m, 50.0).coef, np.linalg.solve(z.T @ z + 50 * np.eye(4), z.T @ v))
    u = z / z.std(0)
    net = L.elastic_net(m, 0.2, 0.5)
    b = net.coef * z.std(0)
    grad = u.T @ (v - u @ b) / 400 - 0.2 * 0.5 * b
    assert all(abs(g - 0.1 * np.sign(w)) < 1e-6 if w else abs(g) <= 0.1 + 1e-6 for g, w in zip(grad, b, strict=True))
    assert L.forward(m, 2) == [1, 0] and L.top_by_correlation(m, 2) == [0, 1]
    assert L.prune(m, L.ols(m), 0.05).active() and len(L.prescreen(m)) == 4
    assert L.ridge_gcv(m, [0.1, 1.0, 10.0])[1] in (0.1, 1.0, 10.0) and L.bayesian_ridge(m)[1] > 0
    assert m.sse(L.round_coefs(L.ols(m), m).coef, L.round_coefs(L.ols(m), m).intercept) <= m.sse(L.ols(m).coef, L.ols(m).intercept) * 1.0011


def test_robust_errors(data, cols):
    x, y, df = data
    z = np.column_stack([np.ones(400), x])
    inv = np.linalg.inv(z.T @ z)
    e = y - z @ (inv @ z.T @ y)
    h = np.einsum("ij,jk,ik->i", z, inv, z)
    want = {"plain": inv * (e @ e) / 395, "HC3": inv @ (z * (e / (1 - h))[:, None] ** 2).T @ z @ inv}
    g = np.stack([(z * e[:, None])[np.arange(400) % 5 == k].sum(0) for k in range(5)])
    want["cluster"] = inv @ g.T @ g @ inv * (5 / 4 * 399 / 395)
    for cov, v in want.items():
        terms, r2, f = H.ols_inference(df, "y", cols, cov, "fold")
        assert np.allclose([t[2] for t in terms], np.sqrt(np.diag(v)), rtol=1e-6)
        assert r2 == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())
    assert H.partial_corr(df, "a", "y", ["b", "c", "d"]) == pytest.approx(np.corrcoef(*(v - np.column_stack([np.ones(400), x[:, 1:]]) @ np.linalg.lstsq(np.column_stack([np.ones(400), x[:, 1:]]), v, rcond=None)[0] for v in (x[:, 0], y)))[0, 1])


def test_tails_by_hand():
    assert dist.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_sf2(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert 2 * dist.normal_sf(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_quantile(0.05, 10) == pytest.approx(2.228139, abs=1e-5)


def test_models_say_what_they_score(spark, data, tmp_path):
    _, _, df = data
    model = TermModel([Term("hinge", "a", 2.0, knot=10.0), Term("gate", "b", 1.5, "c", knot=0.0), Term("linear", "d", 0.0)], 1.0)
    assert model.card().splitlines() == ["y = 1", "  +2 * max(0, a - 10)", "  +1.5 * [b > 0] * c", "no effect: d"]
    row = honesty(model.transform(df), model.column(), F.col("pred")).first()
    assert row.r2 == pytest.approx(1) and row.max_gap == 0
    parts = model.contributions(df, ["id"]).groupBy("id").agg((F.sum("part") + 1).alias("p"))
    assert model.transform(df).join(parts, "id").filter("abs(p - pred) > 1e-9").count() == 0
    assert model.importance(df).agg(F.sum("share")).first()[0] == pytest.approx(1)
    curve = effect_curve(model, df, list("abcd"), "a").orderBy("a").collect()
    assert len(curve) == 60 and curve[-1].pred > curve[0].pred
    assert toggle_effect(linear_model(L.Equation(["a"], np.array([3.0]), 0.0)), df, "a").first()[0] == pytest.approx(3)
    df.write.parquet(str(tmp_path / "in"))
    score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(model.transform(df)).count() == 0


def test_boards(spark):
    perf = spark.createDataFrame([("e1", "d1", "m1", 1.0), ("e1", "d2", "m1", 2.0), ("e1", "d1", "base", 1.0), ("e2", "d1", "base", 3.0), ("e1", "d2", "base", 1.0), ("e1", "d1", "m2", None), ("e1", "d2", "m2", 0.5)], "experiment string, dataset string, model string, rmse double")
    overall = spark.createDataFrame([("e1", "m1", "c1")], "experiment string, model_name string, commit string")
    named = B.canonical_model_id(perf, overall, ["base"])
    assert {r.model_id for r in named.collect()} == {"base", "e1/c1/m1", "e1/unknown/m2"}
    got = {r.model_id: r.mean_rank for r in B.pooled_rank(named).collect()}
    assert got == {"base": 2.0, "e1/c1/m1": 2.0}
    board = spark.createDataFrame([("x", 1.0, 0.2), ("y", 2.0, 0.5), ("z", 3.0, 0.4), ("w", 2.0, 0.5)], "model_id string, mean_rank double, score double")
    assert {r.model_id for r in B.frontier(board).collect()} == {"x", "y", "w"}
    assert {r.model_id for r in B.relaxed(board, board.filter("model_id = 'y'")).collect()} == {"x", "y", "w"}
    facts = spark.createDataFrame([("k", "a", 1)], "k string, v string, n int")
    once = S.upsert(facts, spark.createDataFrame([("k", "b", 2), ("l", "c", 3)], facts.schema), ["k"])
    assert sorted(r.v for r in once.collect()) == ["b", "c"] and sorted(r.v for r in S.upsert(once, once, ["k"]).collect()) == ["b", "c"]
    parsed = B.parse_conclusions(spark.createDataFrame([('so: {"response": 7, "explanation": "e"} end',), ("{broken",), (None,)], "text string")).collect()
    assert [r.response for r in parsed] == [7, None, None] and [r.parse_error for r in parsed] == [False, True, True]


def test_shapes_and_selection(spark):
    hist = spark.createDataFrame([("f", b, 10, s) for b, s in enumerate([0.0, 1.0, 50.0, 52.0])], "feature string, bin int, n int, s double")
    assert A.best_split(hist, 5).first().bin == 1
    shape = spark.createDataFrame([("f", b, v) for b, v in enumerate([0.0, 1.0, 0.0, 1.0])], "feature string, bin int, value double")
    out = [r.value for r in A.smooth(shape, 1).orderBy("bin").collect()]
    assert out == pytest.approx([0.0, 0.6, 0.4, 1.0])
    terms = spark.createDataFrame([("a", -9.0), ("b", 0.9), ("c", 0.1)], "t string, coef double")
    assert [r.t for r in A.mass_select(terms, "coef", 0.9).collect()] == ["a"]


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    one = P.with_fold(P.split(df, ["k"]), ["k"], 5)
    two = P.with_fold(P.split(df.repartition(7), ["k"]), ["k"], 5)
    assert one.exceptAll(two).count() == 0 and 300 < one.filter("split = 'test'").count() < 500
    boot = P.bootstrap(df, ["k"], 3).groupBy("replicate").agg(F.sum("weight").alias("w")).collect()
    assert len(boot) == 3 and all(1800 < r.w < 2200 for r in boot)
    assert P.cap(df, ["k"], 10).count() == 10


def test_sources(spark, tmp_path):
    schema = "dataset string, status string, correctness int"
    for mode, j in (("std", 1), ("new", 2)):
        S.write_facts(spark.createDataFrame([("d", "ok", j), ("d", "bad", 9)], schema).coalesce(1), str(tmp_path / mode), ["dataset", "status", "correctness"])
        next((tmp_path / mode).glob("part*.csv")).rename(tmp_path / f"results_{mode}_run1_judge{j}.csv")
    got = S.read_tagged(spark, str(tmp_path / "results_*.csv"), r"results_(\w+)_run(\d+)_judge(\d+)\.csv", {"mode": 1, "judge": 3}, schema).collect()
    assert {(r["mode"], r.judge, r.correctness) for r in got} == {("std", "1", 1), ("new", "2", 2)}
    assert S.read_optional(spark, {"x": str(tmp_path / "none")}, schema).count() == 0
    (tmp_path / "info.json").write_text(json.dumps({"research_questions": ["q1", "q2"], "data_desc": {"dataset_description": "d", "fields": [{"column": "c", "properties": {"description": "x"}}]}}))
    row = S.read_task_docs(spark, str(tmp_path / "info.json")).first()
    assert (row.question, row.fields) == ("q1", "c: x")
