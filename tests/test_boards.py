"""Boards, reports, preparation and exact quantiles on small tables, by hand or by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainfit.functions import columns as C
from plainfit.operators import aggregate as A
from plainfit.operators import board as B
from plainfit.operators import prep as P
from plainfit.plans.gram import gram
from plainfit.plans.order import exact_quantiles, running
from plainfit.sources import tables as S


def test_exact_quantiles_and_running_totals(spark):
    rng = np.random.default_rng(4)
    rows = [(None if g == 3 else "abc"[g], float(v)) for g, v in zip(rng.integers(0, 4, 500), rng.integers(0, 60, 500), strict=True)]
    df = spark.createDataFrame([*rows, ("a", None), ("b", float("nan"))], "g string, v double").repartition(5)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: [r[f"q{i}"] for i in range(6)] for r in exact_quantiles(df, "v", qs, ["g"]).collect()}
    for g in ("a", "b", "c", None):
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g], qs).tolist())
    assert P.quantiles(df, ["v"], qs)["v"] == pytest.approx(np.quantile([v for _, v in rows], qs).tolist())
    assert P.quantiles(df.limit(0), ["v"], [0.5])["v"] == [None]
    d = {(r.g): r for r in A.describe(df, "v", ["g"]).collect()}
    assert d["a"].q50 == pytest.approx(np.median([v for k, v in rows if k == "a"])) and len(d) == 4
    one = spark.createDataFrame([(int(k), int(v)) for k, v in enumerate(rng.integers(-5, 9, 300))], "k int, v int").repartition(4)
    values = {r.k: r.v for r in one.collect()}
    total = {r.k: r.s for r in running(one, "k", "v", "s").collect()}
    assert all(total[k] == sum(values[j] for j in range(k)) for k in values)
    top = {r.k: r.s for r in running(one, "k", "v", "s", "max").collect()}
    assert all(top[k] == (max(values[j] for j in range(k)) if k else None) for k in values)
    assert running(one.limit(0), "k", "v", "s").count() == 0


def test_nobody_beaten_stays(spark):
    rng = np.random.default_rng(9)
    point = lambda n: [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 12, (n, 2)))]
    cands, refs = point(120), point(25)
    a = spark.createDataFrame([*cands, (900, None, 1.0), (901, 1.0, None)], "id int, lo double, hi double")
    b = spark.createDataFrame([*refs, (1, None, 99.0)], "id int, lo double, hi double")
    beaten = lambda x, y: any(l <= x and h >= y and (l < x or h > y) for _, l, h in refs)  # noqa: E731, E741
    want = {i for i, x, y in cands if not beaten(x, y)} | {900, 901}
    assert {r.id for r in A.non_dominated(a, b, "lo", "hi").collect()} == want
    assert A.non_dominated(a, b.limit(0), "lo", "hi").count() == 122


def test_labels_of_equal_parts(spark):
    rows = [(i, float((i * 37) % 23)) for i in range(90)] + [(90, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(3)
    got = {r.k: r.label for r in A.ntile_label(df, "v", ["k"], ["low", "middle", "high", "top"]).collect()}
    order = sorted((v, k) for k, v in rows if v is not None)
    sizes, at = [23, 23, 22, 22], 0
    for label, n in zip(["low", "middle", "high", "top"], sizes, strict=True):
        assert all(got[k] == label for _, k in order[at : at + n])
        at += n
    assert got[90] is None


def test_ranks_where_a_dataset_has_no_error_at_all(spark):
    perf = spark.createDataFrame([("d1", "a", 1.0), ("d1", "b", 2.0), ("d2", "a", None), ("d2", "b", None)], "dataset string, model_id string, rmse double")
    assert B.pooled_rank(perf).count() == 0
    part = spark.createDataFrame([("d1", "a", 1.0), ("d1", "a", 3.0), ("d1", "b", 2.0), ("d2", "a", 1.0), ("d2", "b", None)], perf.schema)
    assert {r.model_id: r.mean_rank for r in B.pooled_rank(part).collect()} == {"a": 1.25}
    both = B.mean_rank(part.dropDuplicates(["dataset", "model_id"]).withColumnRenamed("model_id", "model"))
    assert {r.model: r.mean_rmse is None for r in both.collect()} == {"a": False, "b": True}


@pytest.fixture(scope="module")
def experiments(spark):
    overall = spark.createDataFrame(
        [("e1", "baseline", "ols", "o", 9.0), ("e2", "baseline", "ols", "o", 8.0), ("e1", "abc", "m1", "x", 1.0), ("e2", "def", "m2", "y", 2.0), ("e2", "fff", "bad", "z", 3.0)],
        "experiment string, commit string, model_name string, description string, mean_rank double",
    )
    perf = spark.createDataFrame(
        [(e, d, m, r) for e, m, rs in (("e1", "ols", (3.0, 3.0)), ("e2", "ols", (5.0, 1.0)), ("e1", "m1", (1.0, 2.0)), ("e2", "m2", (2.0, 1.0)), ("e2", "bad", (9.0, None))) for d, r in zip(("d1", "d2"), rs, strict=True)],
        "experiment string, dataset string, model string, rmse double",
    )
    facts = [("e1", "ols", "t1", True), ("e1", "ols", "t2", False), ("e1", "m1", "t1", True), ("e1", "m1", "t2", True), ("e2", "m2", "t1", False), ("e2", "m2", "t2", None), ("e2", "bad", "t1", True), ("e2", "ols", "t1", True)]
    dev = spark.createDataFrame(facts, "experiment string, model string, test string, passed boolean")
    tests = spark.createDataFrame([("t1", "A"), ("t2", "B")], "test string, category string")
    files = spark.createDataFrame([("lib/failure/abc_one.py", 1), ("lib/success/abc_one.py", 0), ("lib/success/def_two.py", 0)], "path string, place int")
    return overall, perf, dev, tests, files


def test_combined_leaderboard_and_frontiers(spark, experiments):
    overall, perf, dev, tests, files = experiments
    board = B.combined_leaderboard(perf, overall, dev, dev, ["A", "B"], tests, files)
    got = board.collect()
    # d1: m1 1, m2 2, ols 4, bad 9; d2: m2 1, m1 2 and ols 2
    assert [(r.model_id, r.mean_rank_global) for r in got] == [("e2/def/m2", 1.5), ("e1/abc/m1", 1.75), ("ols", 2.75)]
    by = {r.model_id: r for r in got}
    assert by["ols"].experiment == "e1" and by["ols"].artifact is None and by["ols"].dev_score == 0.5
    assert by["e1/abc/m1"].artifact == "lib/success/abc_one.py" and by["e2/def/m2"].dev_B is None and by["e2/def/m2"].test_A == 0.0
    flags = {r.model_id: (r.on_baseline_front, r.on_evolved_front, r.on_combined_front, r.beaten_by_no_baseline) for r in B.frontier_report(board).collect()}
    assert flags == {"ols": (True, False, False, False), "e1/abc/m1": (False, True, True, True), "e2/def/m2": (False, False, False, False)}  # a score of 0 takes no part
    fresh = {r.model_name: r.mean_rank for r in B.refresh_ranks(overall, perf.filter("experiment = 'e1'")).collect()}
    assert fresh["m1"] == 1.0 and fresh["ols"] == 2.0 and fresh["m2"] is None


def test_suites_pivots_and_collapses(spark):
    facts = spark.createDataFrame([("m", "hard_a", True), ("m", "hard_b", False), ("m", "plain", True), ("m", "insight_x", None), ("n", "plain", False)], "model string, test string, passed boolean")
    got = {r.model: r for r in A.suite_counts(facts, ["hard", "insight"], ["model"]).collect()}
    assert (got["m"].hard_passed, got["m"].hard_tests, got["m"].standard_passed, got["m"].insight_tests, got["n"].standard_tests) == (1, 2, 1, 1, 1)
    assert {r.model: r.pass_rate for r in A.pass_rate(facts, ["model"]).collect()} == {"m": pytest.approx(2 / 3), "n": 0.0}
    one = {r.model: r.v for r in A.collapse(spark.createDataFrame([("m", 1.0), ("m", 3.0), ("n", None)], "model string, v double"), ["model"], ["v"]).collect()}
    assert one == {"m": 2.0, "n": None}
    wide = A.pivot_mean(facts.withColumn("p", F.col("passed").cast("double")), ["model"], "test", ["plain", "hard_a"], "p").collect()
    assert {r.model: (r.plain, r.hard_a) for r in wide} == {"m": (1.0, 1.0), "n": (0.0, None)}
    v = np.array([1.0, 2.0, 2.0, 9.0])
    z = (v - v.mean()) / v.std()
    row = A.shape_stats(spark.createDataFrame([(float(x),) for x in v], "v double"), ["v"]).first()
    assert row["skewness"] == pytest.approx((z**3).mean()) and row["kurtosis"] == pytest.approx((z**4).mean() - 3)
    shape = spark.createDataFrame([("f", b, float(x)) for b, x in enumerate([0, 0, 16, 0, 0])], "feature string, bin int, value double")
    assert [r.value for r in A.smooth_five(shape).orderBy("bin").collect()] == pytest.approx([16 / 11, 64 / 15, 6.0, 64 / 15, 16 / 11])


def test_judges_and_annotations(spark):
    rows = [(m, r, j, d, *s) for m, r, j, d, s in [("new", 1, 1, "x", (8, 6, 7)), ("new", 1, 1, "y", (6, 6, 6)), ("new", 2, 1, "x", (9, 9, None)), ("old", 1, 1, "x", (4, 5, 6))]]
    scores = spark.createDataFrame(rows, "mode string, run_id int, judge_id int, dataset string, correctness int, completeness int, clarity int")
    got = {(r["mode"], r.dataset, r.dimension): (r["mean"], r.se, r.n) for r in B.judge_report(scores).collect()}
    assert got["new", "x", "correctness"] == (8.5, pytest.approx(0.5), 2)
    assert got["new", "AVERAGE", "correctness"] == (8.0, pytest.approx(1.0), 2)
    first, second = (7 + 6 + 6.5) / 3, 9.0
    assert got["new", "AVERAGE", "overall"][0] == pytest.approx((first + second) / 2) and got["old", "AVERAGE", "overall"] == (5.0, 0.0, 1)
    cells = {r.dimension: (r.new, r.old) for r in B.compare_modes(scores, ["new", "old"]).collect()}
    assert cells["correctness"] == ("8.00±1.00", "4.00±0.00")
    specs = [(1, '{"concept": "age", "variable_type": "control"}', '{"m": "OLS with logit"}', "t"), (2, "{broken", "{also broken", None), (3, '{"concept": ""}', '{"m": "poisson GLM"}', "t"), (4, '{"concept": "sex"}', None, None)]
    df = spark.createDataFrame(specs, "ord int, conceptual_spec_json string, model_spec_json string, annotate_transform_spec_json string")
    row = B.annotation_summary(df).first()
    assert (row.specifications, row.models, row.transforms, row.concepts) == (4, 2, 2, ["control: age", ": sex"]) and row.families == "GLM, OLS, Poisson, logit"
    assert {r.k: r.specifications for r in B.annotation_summary(df.withColumn("k", F.col("ord") % 2), ["k"], 1).collect()} == {0: 2, 1: 2}


def test_preparation(spark):
    df = spark.createDataFrame([(i, float(i), float(10 * i + 3), "s") for i in range(100)], "id int, a double, b double, c string")
    for kind, shift, width in (("standard", 49.5, np.arange(100).std()), ("minmax", 0.0, 99.0)):
        s = P.Scaler(["a", "b"], kind).fit(df)
        row = s.transform(df).filter("id = 7").first()
        assert row.a == pytest.approx((7 - shift) / width)
        raw, base = s.unscale({"a": 2.0, "b": 3.0}, 1.0)
        assert raw["a"] * 7 + raw["b"] * 73 + base == pytest.approx(2 * row.a + 3 * row.b + 1)
    m = gram(df, {"a": F.col("a")}, F.col("b"))[()]
    assert P.check_size(m, 100) and not P.check_size(m, 101) and not P.check_size(m, 10, 2)
    few = P.cap(df, ["id"], 10, features=["a", "b"], max_features=1)
    assert few.count() == 10 and len({"a", "b"} & set(few.columns)) == 1 and "c" in few.columns
    train, valid = P.holdout(df, ["id"], 0.1, 20)
    assert train.intersect(valid).count() == 0 and train.count() + valid.count() == 100 and 8 <= valid.count() <= 35
    same = P.holdout(df.limit(30), ["id"])
    assert same[0].count() == same[1].count() == 30
    assert P.split_columns(df) == (["id", "a", "b"], ["c"])
    t, v = P.normalize_label(df.withColumn("label", F.col("a")), df.withColumn("label", F.lit(49.5)))
    assert t.agg(F.stddev_pop("label")).first()[0] == pytest.approx(1) and v.first().label == pytest.approx(0)
    flat = df.withColumn("label", F.lit(2.0))
    assert P.normalize_label(flat, flat)[0].first().label == 2.0
    x = spark.createDataFrame([(4.0,), (-4.0,), (0.5,)], "x double")
    got = {k: [r[0] for r in x.select(C.transformed(F.col("x"), k)).collect()] for k in C.TRANSFORMS}
    assert got["log"][1] is None and got["sqrt"] == [2.0, None, pytest.approx(0.5**0.5)] and got["signed_sqrt"][1] == -2.0 and got["arcsin"][0] is None and got["square"] == [16.0, 16.0, 0.25]
    assert got["log1p"][2] == pytest.approx(np.log(1.5)) and got["decay"][0] == pytest.approx(np.exp(-4))
    bins = [[r[i] for r in x.select(*C.binned(F.col("x"), [-1.0, 0.5])).collect()] for i in range(3)]
    assert bins == [[0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0]]
    assert set(C.poly2(["a", "b"])) == {"a", "b", "a^2", "b^2", "a*b"}
    assert {r.a: r["x_b"] for r in P.dummies(spark.createDataFrame([("a",), ("b",)], "x string").withColumn("a", F.col("x")), "x", ["a", "b"], ref="a").collect()} == {"a": 0.0, "b": 1.0}
    row = spark.createDataFrame([(1.0, None, 4.0)], "a double, b double, c double").select(C.row_mean(F.col("a"), F.col("b"), F.col("c"))).first()
    assert row[0] == 2.5


def test_more_sources(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.option("header", True).csv(str(tmp_path / "c"))
    assert [tuple(r) for r in S.read_table(spark, str(tmp_path / "c"), fmt="csv").collect()] == [(1, "x")]
    for name, schema, row in (("one", "a int, b string", (1, "x")), ("two", "a int", (2,))):
        spark.createDataFrame([row], schema).write.option("header", True).csv(str(tmp_path / name))
    both = S.read_optional(spark, {"one": str(tmp_path / "one"), "two": str(tmp_path / "two"), "none": str(tmp_path / "none")}, "a int, b string", "csv").collect()
    assert sorted((r.experiment, r.a, r.b) for r in both) == [("one", 1, "x"), ("two", 2, None)]
    S.write_json(spark.createDataFrame([(7, "e")], "response int, explanation string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().response == 7


def test_grid_is_taken_up_again_and_products_follow_their_columns(spark):
    from plainfit.operators import additive as G
    from plainfit.operators import glm as M
    from plainfit.operators import teacher as E
    from plainfit.operators.model import linear_model
    from plainfit.operators.linear import ols

    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    y = x[:, 0] * x[:, 1] * 4 + x[:, 2]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, label double")
    fit = lambda rows: linear_model(ols(gram(rows, {c: F.col(c) for c in "abc"}, F.col("label"))[()]))
    sets = {"d": (df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")), "tiny": (df.limit(3), df)}
    done = spark.createDataFrame([("d", "old")], "dataset string, model string")
    got = {(r.dataset, r.model): (r.rmse is not None, r.error) for r in E.evaluate({"old": fit, "new": fit}, sets, "label", done).collect()}
    assert got == {("d", "new"): (True, None), ("tiny", "old"): (False, "3 rows are too few"), ("tiny", "new"): (False, "3 rows are too few")}
    free = G.symbolic(df, ["a", "b", "c"], F.col("label"), F.col("id") % 5 == 0, kinds=("linear", "interact"))
    held = G.symbolic(df, ["a", "b", "c"], F.col("label"), F.col("id") % 5 == 0, kinds=("linear", "interact"), hierarchy=True)
    assert any(t.kind == "interact" for t in free.terms)
    assert len([t for t in held.terms if t.b]) <= len([t for t in free.terms if t.b])  # small lines go in the end, products stay
    none = G.symbolic(df, ["a", "b"], F.col("label"), F.col("id") % 5 == 0, kinds=("interact",), hierarchy=True)
    assert not none.terms
    assert [r.id for r in A.top_by_size(df.select("id", "a"), "a", 3, "id").collect()] == np.argsort(-abs(x[:, 0]))[:3].tolist()
    # shares with trials as weights equal the rows they stand for
    rows = spark.createDataFrame([(g, v) for g, n, k in ((0, 50, 20), (1, 40, 30)) for v in [1] * k + [0] * (n - k)], "g int, v int")
    shares = spark.createDataFrame([(0, 0.4, 50), (1, 0.75, 40)], "g int, share double, trials int")
    one, two = M.glm(rows, F.col("v"), {"g": F.col("g")}), M.glm(shares, F.col("share"), {"g": F.col("g")}, weight=F.col("trials"))
    assert [e.coef for e in one] == pytest.approx([e.coef for e in two], abs=1e-6) and one[1].coef == pytest.approx(np.log(3) - np.log(2 / 3), abs=1e-6)
