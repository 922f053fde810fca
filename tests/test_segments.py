"""Running totals, ranks, frontiers and quantiles within groups of any size, moments by both ways, splines, subsampled boosting, long shapes and the memo."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainfit.operators import additive as G
from plainfit.operators import aggregate as A
from plainfit.operators import prep as P
from plainfit.operators import splines as N
from plainfit.plans import gram as gram_module
from plainfit.plans.gram import gram
from plainfit.plans.order import exact_quantiles, running
from plainfit.sources import tables as S


@pytest.fixture(scope="module")
def grouped(spark):
    """One group with nearly all rows, null groups and null values."""
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 50 else [None, "a", "b"][i // 50 % 3], int(rng.integers(0, 400)), float(rng.integers(0, 90)), i) for i in range(3000)]
    rows += [("hot", None, 1.0, 4000), ("hot", 5, None, 4001)]
    return rows, spark.createDataFrame(rows, "g string, v int, w double, i int").repartition(6).cache()


def spread(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals_start_again_in_each_group(spark, grouped, monkeypatch):
    rows, df = grouped
    back = spread(spark, monkeypatch)
    try:
        known = df.filter("v is not null and w is not null")
        for kind, start, add in (("sum", 0.0, lambda a, b: a + b), ("max", None, lambda a, b: b if a is None else max(a, b))):
            got = {r.i: r.before for r in running(known, ["v", "i"], "w", "before", kind, ["g"]).collect()}
            held = {}
            for g, v, w, i in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[3])):
                assert got[i] == held.get(g, start), (kind, g, v)
                held[g] = add(held.get(g, start), w)
    finally:
        back()


def test_grouped_ranks_and_frontiers(spark, grouped, monkeypatch):
    rows, df = grouped
    back = spread(spark, monkeypatch)
    try:
        ranks = {r.i: r["rank"] for r in A.avg_rank(df, ["g"], "v").collect()}
        assert len(ranks) == len(rows)
        for g, v, _, i in rows[::37] + rows[-2:]:
            own = [r[1] for r in rows if r[0] == g and r[1] is not None]
            assert ranks[i] == (None if v is None else sum(x < v for x in own) + (own.count(v) + 1) / 2)
        front = sorted(map(tuple, A.pareto(df, "v", "w", ["g"]).select("g", "v", "w").collect()), key=repr)
        want = []
        for g in {r[0] for r in rows}:
            own = sorted({(r[1], r[2]) for r in rows if r[0] == g and r[1] is not None and r[2] is not None}, key=lambda x: (x[0], -x[1]))
            best = -1.0
            for v, w in own:
                if w > best:
                    want.append((g, v, w))
                    best = w
        assert front == sorted(want, key=repr)
    finally:
        back()


def test_quantiles_of_groups_and_columns(spark, grouped, monkeypatch):
    rows, df = grouped
    back = spread(spark, monkeypatch)
    try:
        got = {r.g: (r.q0, r.q1, r.q2) for r in exact_quantiles(df, "v", [0.0, 0.3, 1.0], ["g"]).collect()}
        assert got.keys() == {r[0] for r in rows}
        for g, found in got.items():
            assert np.allclose(found, np.quantile([r[1] for r in rows if r[0] == g and r[1] is not None], [0.0, 0.3, 1.0]))
        both = P.quantiles(df, ["v", "w"], [0.25, 0.9])
        for c, k in (("v", 1), ("w", 2)):
            assert np.allclose(both[c], np.quantile([r[k] for r in rows if r[k] is not None], [0.25, 0.9]))
        assert P.quantiles(df.limit(0), ["v", "w"], [0.5]) == {"v": [None], "w": [None]}
        assert tuple(exact_quantiles(df.limit(1).select(F.lit(2.0).alias("v")), "v", [0.1, 0.5]).first()) == (2.0, 2.0)
    finally:
        back()


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("weighted", [False, True])
def test_moments_by_both_ways_equal_numpy(spark, monkeypatch, by, weighted):
    rng = np.random.default_rng(6)
    x = rng.normal(1e6, 3, (900, 4))
    g, w = rng.integers(0, 3, 900), rng.uniform(0.5, 2, 900)
    cells = [[None if rng.random() < 0.02 else float(v) for v in r] for r in x]
    cells[5][1] = float("nan")
    df = spark.createDataFrame([(int(k), float(u), *r) for k, u, r in zip(g, w, cells, strict=True)], "g int, w double, a double, b double, c double, y double").repartition(5)
    whole = [i for i, r in enumerate(cells) if all(v is not None and v == v for v in r)]
    for most in (8, 0):
        monkeypatch.setattr(gram_module, "MOST_PLAIN", most)
        found = gram(df, {k: F.col(k) for k in "abc"}, F.col("y"), by, F.col("w") if weighted else None)
        for key, m in found.items():
            at = [i for i in whole if not by or g[i] == key[0]]
            weight = w[at] if weighted else np.ones(len(at))
            mean, s, c, yy, label = m.centered()
            z = x[at] - np.average(x[at], axis=0, weights=weight)
            full = (z * weight[:, None]).T @ z
            assert m.rows == len(at) and np.isclose(m.n, weight.sum())
            assert np.allclose([*mean, label], np.average(x[at], axis=0, weights=weight), rtol=1e-12)
            assert np.allclose(s, full[:3, :3], rtol=1e-6, atol=1e-4) and np.allclose(c, full[:3, 3], rtol=1e-6, atol=1e-4) and np.isclose(yy, full[3, 3])
        assert len(found) == (3 if by else 1)


def test_spline_bases_add_up_to_one_and_score_as_their_sql(spark):
    import duckdb

    x = [float(v) for v in np.linspace(-3, 14, 120)] + [0.0, 10.0]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [[v] for v in x])
    for degree in (1, 2, 3, 4):
        terms = N.bases("x", 0.0, 10.0, 9, degree)
        rows = df.select("x", *(t.column().alias(f"b{i}") for i, t in enumerate(terms))).collect()
        values = np.array([list(r)[1:] for r in rows if r.x is not None])
        assert np.allclose(values.sum(axis=1), 1) and values.min() > -1e-12 and ((values > 1e-12).sum(axis=1) <= degree + 1).all()
        assert all(v is None for v in list(rows[-1])[1:])
        assert np.allclose(values, [[N.value(t, v) for t in terms] for v in x])
        assert np.allclose(values, np.array(con.execute(f"SELECT {', '.join(t.sql() for t in terms)} FROM t").fetchall()))


def test_splines_follow_a_wave_and_their_strength_a_line(spark):
    rng = np.random.default_rng(9)
    x, z = rng.uniform(0, 10, 1500), rng.uniform(0, 1, 1500)
    y = np.sin(x) + 2 * z + rng.normal(0, 0.1, 1500)
    df = spark.createDataFrame([(float(a), float(b), 4.0, float(c)) for a, b, c in zip(x, z, y, strict=True)] + [(None, 0.5, 4.0, 1.0)], "x double, z double, flat double, y double")
    model = N.spline_gam(df, ["x", "z", "flat"], F.col("y"))
    scored = model.transform(df).filter("x is not null").select("x", "z", "pred").toPandas()
    assert np.sqrt(np.mean((scored.pred - np.sin(scored.x) - 2 * scored.z) ** 2)) < 0.06
    assert model.columns() == ["x", "z"] and 8 < model.freedom < 20 and "s(x):" in model.card()
    line = spark.createDataFrame([(float(a), float(3 * a + e)) for a, e in zip(x, rng.normal(0, 1, 1500), strict=True)], "x double, y double")
    straight = N.spline_gam(line, ["x"], F.col("y"))
    assert straight.strength == N.STRENGTHS[-1] and straight.freedom < 4
    none = N.spline_gam(df.limit(0), ["x"], F.col("y"))
    assert none.terms == [] and none.intercept == 0.0


def test_subsampled_boosting_equals_a_loop_over_rows(spark):
    rng = np.random.default_rng(12)
    a, b = rng.integers(0, 8, 800), rng.integers(0, 5, 800)
    y = np.where(a > 3, 2.0, 0.0) + b + rng.normal(0, 0.3, 800)
    df = spark.createDataFrame([(int(i), float(p), float(q), float(r)) for i, (p, q, r) in enumerate(zip(a, b, y, strict=True))], "i int, a double, b double, y double")
    edges = [[float(k) for k in range(7)], [float(k) for k in range(4)]]
    options = {"parts": 6, "share": 0.5, "rounds": 25, "rate": 0.3, "edges": edges, "seed": 4}
    models = [G.stochastic_gam(d, ["a", "b"], F.col("y"), F.col("i") % 6, F.lit(False), **options) for d in (df, df.repartition(7, "b"))]
    assert models[0].card() == models[1].card()
    pred, draw = np.full(800, y.mean()), np.random.default_rng(4)
    for _ in range(25):
        on, rest, best = np.isin(np.arange(800) % 6, draw.permutation(6)[:3]), y - pred, None
        for x, bounds in ((a, edges[0]), (b, edges[1])):
            for k in bounds:
                left = x <= k
                n, m = (on & left).sum(), (on & ~left).sum()
                if min(n, m) >= 5:
                    s, t = rest[on & left].sum(), rest[on & ~left].sum()
                    if best is None or s * s / n + t * t / m > best[0] + 1e-9:
                        best = s * s / n + t * t / m, left, s / n, t / m
        pred = pred + 0.3 * np.where(best[1], best[2], best[3])
    pred += y.mean() - pred.mean()
    got = models[0].transform(df).orderBy("i").toPandas().pred
    assert np.allclose(got, pred)
    stopped = G.stochastic_gam(df, ["a", "b"], F.col("y"), F.col("i") % 6, F.col("i") % 5 == 0, **{**options, "rounds": 400})
    assert np.sqrt(np.mean((stopped.transform(df).orderBy("i").toPandas().pred - y) ** 2)) < 0.6
    assert G.stochastic_gam(df.limit(0), ["a"], F.col("y"), F.col("i") % 6, F.lit(False), parts=6).terms == []


def test_long_shapes_are_found_by_halving(spark):
    rng = np.random.default_rng(2)
    terms = [N.Term("step", c, float(rng.normal()), knot=float(k)) for c, n in (("x", 1000), ("place0", 33), ("z", 5)) for k in rng.choice(5000, n, replace=False)]
    model = G.ShapeModel([*terms, N.Term("linear", "z", 0.5)], 1.0)
    rows = [(float(v), float(v % 977), float(v % 13), "k") for v in range(0, 5200, 13)] + [(None, 1.0, 2.0, "k"), (1.0, 3.0, None, "k")]
    df = spark.createDataFrame(rows, "x double, place0 double, z double, pred0 string")
    scored = model.transform(df)
    assert scored.columns == [*df.columns, "pred"]
    assert "(1) " in scored._jdf.queryExecution().executedPlan().toString()  # one stage of generated code
    got = scored.filter("z is not null").toPandas()
    want = 1.0 + 0.5 * got.z
    for t in terms:
        want = want + t.coef * (got[t.a] > t.knot)  # a null is above nothing
    missing = got.x.isna()
    assert np.allclose(got.pred[~missing], want[~missing]) and np.isclose(got.pred[missing].iloc[0], want[missing].iloc[0])


def test_fingerprints_and_work_done_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.0), (2, None, 3.0)], "k int, s string, v double")
    same = S.fingerprint(df, {"depth": 3})
    assert same == S.fingerprint(df.repartition(3), {"depth": 3})
    others = [S.fingerprint(df, {"depth": 4}), S.fingerprint(df.distinct(), {"depth": 3}), S.fingerprint(df.withColumn("k", F.col("k").cast("long")), {"depth": 3}), S.fingerprint(df.withColumnRenamed("v", "w"), {"depth": 3}), S.fingerprint(df.limit(0), {"depth": 3})]
    swapped = spark.createDataFrame([(1, None, "a")], "k int, s string, v string")
    others += [S.fingerprint(swapped, {}), S.fingerprint(swapped.select("k", F.col("v").alias("s"), F.col("s").alias("v")), {})]
    assert len({same, *others}) == len(others) + 1
    calls = []

    def work():
        calls.append(1)
        return df.groupBy("k").count()

    for _ in range(2):
        assert S.once(spark, str(tmp_path / "memo"), df, {"depth": 3}, work).count() == 2
    assert len(calls) == 1
    S.once(spark, str(tmp_path / "memo"), df.filter("k = 1"), {"depth": 3}, work)
    assert len(calls) == 2 and json.dumps(calls)
