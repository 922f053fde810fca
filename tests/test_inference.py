"""Tests, designs and weights against NumPy, by hand where there is nothing to compare with."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainfit.functions import dist
from plainfit.operators import inference as H
from plainfit.plans.gram import fit_by, gram
from plainfit.operators import linear as L


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 300
    g, k = rng.integers(0, 3, n), rng.integers(0, 12, n)
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * x - z + 0.7 * (g == 1) + 0.3 * x * (g == 2) + rng.normal(size=n) * (0.5 + (g == 2))
    w = rng.integers(1, 5, n).astype(float)
    rows = [(i, "abc"[a], int(b), float(p), float(q), float(r), float(s)) for i, (a, b, p, q, r, s) in enumerate(zip(g, k, x, z, y, w, strict=True))]
    holes = [(1000 + i, "a", 1, None, 1.0, 5.0, 2.0) for i in range(40)] + [(2000 + i, "b", 2, 1.0, 1.0, None, None) for i in range(40)]
    return g, k, x, z, y, w, spark.createDataFrame(rows + holes, "id long, g string, k int, x double, z double, y double, w double").repartition(4).cache()


def test_weights_and_nulls_in_all_errors(data):
    g, k, x, z, y, w, df = data
    cols = {"x": F.col("x"), "z": F.col("z")}
    d = np.column_stack([np.ones(len(x)), x, z])
    for weight, v in ((None, np.ones(len(x))), (F.col("w"), w), (F.lit(1.0), np.ones(len(x)))):
        inv = np.linalg.inv(d.T @ (d * v[:, None]))
        e = y - d @ (inv @ d.T @ (v * y))
        h = v * np.einsum("ij,jk,ik->i", d, inv, d)
        n, p = d.shape
        want = {"plain": inv * (v @ e**2) / (n - p), "HC3": inv @ (d * ((v * e / (1 - h)) ** 2)[:, None]).T @ d @ inv}
        s = np.stack([(d * (v * e)[:, None])[k == c].sum(0) for c in np.unique(k)])
        groups = len(s)
        want["cluster"] = inv @ s.T @ s @ inv * (groups / (groups - 1) * (n - 1) / (n - p))
        for cov, m in want.items():
            terms, r2, f = H.ols_inference(df, "y", cols, cov, "k", weight)
            assert np.allclose([t[2] for t in terms], np.sqrt(np.diag(m)), rtol=1e-6), cov
            assert terms[1][4] == pytest.approx(dist.t_sf2(terms[1][1] / terms[1][2], n - p), abs=1e-12)


def test_factors_interactions_and_type_two_sums(data):
    g, k, x, z, y, w, df = data
    cols, terms = H.design(df, ["x", "z"], {"g": "b"}, [("x", "g")])
    assert list(cols) == ["x", "z", "g[a]", "g[c]", "x:g[a]", "x:g[c]"] and terms["x:g"] == ["x:g[a]", "x:g[c]"]
    parts = {"x": x[:, None], "z": z[:, None], "g": np.column_stack([g == 0, g == 2]).astype(float)}
    parts["x:g"] = parts["x"] * parts["g"]
    design = lambda names: np.column_stack([np.ones(len(x)), *(parts[t] for t in names)])
    sse = lambda names: ((y - design(names) @ np.linalg.lstsq(design(names), y, rcond=None)[0]) ** 2).sum()
    table = {t: (d, ss, f, p) for t, d, ss, f, p in H.anova_lm(gram(df, cols, F.col("y"))[()], terms)}
    whole, rest = sse(["x", "z", "g", "x:g"]), len(x) - 7
    assert table["residual"][0] == rest and table["residual"][1] == pytest.approx(whole)
    for t, others in {"x": ["z", "g"], "z": ["x", "g", "x:g"], "g": ["x", "z"], "x:g": ["x", "z", "g"]}.items():
        ss = sse(others) - sse([*others, t])
        d = parts[t].shape[1]
        assert table[t][:2] == (d, pytest.approx(ss, rel=1e-6)) and table[t][2] == pytest.approx(ss / d / (whole / rest), rel=1e-6)
    got, r2, _ = H.ols_inference(df, "y", cols)
    want = np.linalg.lstsq(design(["x", "z", "g", "x:g"]), y, rcond=None)[0]
    assert np.allclose([t[1] for t in got], want)


def test_sides_pairs_and_ranks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0.4, 1, 40), rng.normal(0, 2, 40)
    df = spark.createDataFrame([(i, c, float(v)) for c, xs in (("a", a), ("b", b)) for i, v in enumerate(xs)] + [(99, "a", 100.0)], "e long, c string, v double")
    t = (a - b).mean() / ((a - b).std(ddof=1) / math.sqrt(40))
    for side in H.SIDES:
        got = H.ttest_rel(df, "e", "c", "v", "a", "b", side)
        assert got.statistic == pytest.approx(t) and got.df == 39
    two, more, less = (H.ttest_rel(df, "e", "c", "v", "a", "b", s).p for s in H.SIDES)
    assert more == pytest.approx(two / 2) and less == pytest.approx(1 - two / 2)
    assert H.cohens_dz(df, "e", "c", "v", "a", "b") == pytest.approx((a - b).mean() / (a - b).std(ddof=1))
    assert H.cohens_h(0.5, 0.25) == pytest.approx(2 * math.asin(0.5**0.5) - 2 * math.asin(0.5))
    small = spark.createDataFrame([("a", float(v)) for v in (1, 3, 3, 7)] + [("b", float(v)) for v in (0, 2, 3)], "c string, v double")
    u = sum((x > y) + 0.5 * (x == y) for x in (1, 3, 3, 7) for y in (0, 2, 3))
    assert H.mann_whitney(small, "v", "c", "a", "b").statistic == u
    assert H.mann_whitney(small, "v", "c", "a", "b", "greater").p < 0.5 < H.mann_whitney(small, "v", "c", "a", "b", "less").p
    d = np.array([1.5, -0.5, 2.0, 0.0, 3.0, -1.0, 2.0])
    ranks = {0.5: 1, 1.0: 2, 1.5: 3, 2.0: 4.5, 3.0: 6}
    got = H.wilcoxon(spark.createDataFrame([(float(v),) for v in d], "d double"), F.col("d"))
    assert got.statistic == sum(ranks[abs(v)] for v in d if v > 0) and got.df == 6
    one = H.ttest_1samp(spark.createDataFrame([(float(v),) for v in d], "d double"), F.col("d"), 0.5)
    assert one.statistic == pytest.approx((d.mean() - 0.5) / (d.std(ddof=1) / math.sqrt(7)))


def test_proportions_and_tables(spark):
    cells = {("p", 1): 30, ("p", 0): 20, ("q", 1): 15, ("q", 0): 35}
    df = spark.createDataFrame([(g, v) for (g, v), n in cells.items() for _ in range(n)], "g string, v int")
    p = 45 / 100
    assert H.prop_ztest(df, "v", "g", "p", "q").statistic == pytest.approx((0.6 - 0.3) / math.sqrt(p * (1 - p) * (1 / 50 + 1 / 50)))
    table = np.array([[30, 20], [15, 35]])
    expected = np.outer(table.sum(1), table.sum(0)) / 100
    yates = (((abs(table - expected) - 0.5) ** 2) / expected).sum()
    got = H.chi2_contingency(df, "g", "v")
    assert got.statistic == pytest.approx(yates) and got.df == 1 and got.p == pytest.approx(math.erfc(math.sqrt(yates / 2)), abs=1e-9)
    plain = H.chi2_contingency(df, "g", "v", correction=False)
    assert plain.statistic == pytest.approx(((table - expected) ** 2 / expected).sum())
    wide = spark.createDataFrame([(i % 3, i % 4) for i in range(20)] + [(0, 0)] * 5, "g int, v int")
    t = np.zeros((3, 4))
    for i in range(20):
        t[i % 3, i % 4] += 1
    t[0, 0] += 5
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    assert H.chi2_contingency(wide, "g", "v").statistic == pytest.approx(((t - e) ** 2 / e).sum())
    rows = spark.createDataFrame([(i % 4, float((i * 7) % 11 + i % 4)) for i in range(60)], "g int, v double")
    groups = [np.array([(i * 7) % 11 + i % 4 for i in range(60) if i % 4 == k], dtype=float) for k in range(4)]
    grand = np.concatenate(groups).mean()
    f = sum(len(x) * (x.mean() - grand) ** 2 for x in groups) / 3 / (sum(((x - x.mean()) ** 2).sum() for x in groups) / 56)
    assert H.anova_oneway(rows, "v", "g").statistic == pytest.approx(f)


def test_classifiers_and_evidence(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * 2 + rng.logistic(size=400) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y int")
    got = H.classifiers(df, F.col("y"), ["a", "b", "c"], F.col("id") % 4 == 0).collect()
    best = {m: max((r for r in got if r.model == m), key=lambda r: r.importance) for m in ("logistic", "tree")}
    assert all(r.column == "a" and r.auc > 0.7 for r in best.values())
    held = [i for i in range(400) if i % 4 == 0]
    pos, neg = [x[i, 0] for i in held if y[i]], [x[i, 0] for i in held if not y[i]]
    assert best["logistic"].auc == pytest.approx(np.mean([[(p > q) + 0.5 * (p == q) for q in neg] for p in pos]), abs=0.06)
    evidence = [("strong", 0.001, 0.01, 1.0, 1, False), ("moderate", 0.01, 0.2, 0.5, 2, False), ("weak", 0.03, 0.4, 0.2, 9, False), ("none", 0.6, 0.7, 0.0, 9, True), ("unknown", None, None, None, None, None)]
    score = {r.name: r.score for r in H.evidence_score(spark.createDataFrame(evidence, "name string, p double, p_controlled double, agreement double, importance_rank int, zeroed boolean")).collect()}
    assert score == {"strong": 100.0, "moderate": 55.0, "weak": 20.0, "none": 0.0, "unknown": 15.0}


def test_fits_of_many_groups_stay_in_the_executors(data, monkeypatch):
    g, k, x, z, y, w, df = data
    from plainfit.plans import gram as M

    for most in (M.MOST_PLAIN, 0):
        monkeypatch.setattr(M, "MOST_PLAIN", most)
        got = {r.k: r for r in fit_by(df.filter("k <> 1 and k <> 2 or x is not null and y is not null"), {"x": F.col("x"), "z": F.col("z")}, F.col("y"), ["k"], lambda m: L.ridge(m, 0.5)).collect()}
        assert len(got) == 12
        for c in range(12):
            d = np.column_stack([x, z])[k == c]
            dc, yc = d - d.mean(0), y[k == c] - y[k == c].mean()
            assert np.allclose(got[c].coef, np.linalg.solve(dc.T @ dc + 0.5 * np.eye(2), dc.T @ yc), atol=1e-8) and got[c].n == (k == c).sum()


def test_linear_family(spark, data):
    g, k, x, z, y, w, df = data
    rng = np.random.default_rng(11)
    m = rng.normal(size=(250, 6))
    m[:, 5] = m[:, 0] * 0.9 + 0.1 * m[:, 5]
    v = 3 * m[:, 0] - 2 * m[:, 1] + m[:, 2] + rng.normal(size=250) * 0.3
    names = [f"c{i}" for i in range(6)]
    t = spark.createDataFrame([(i, *map(float, r), float(q)) for i, (r, q) in enumerate(zip(m, v, strict=True))], "id long, " + ", ".join(f"{c} double" for c in names) + ", y double").cache()
    cols = {c: F.col(c) for c in names}
    folds = gram(t.withColumn("f", F.col("id") % 5), cols, F.col("y"), ["f"])
    whole = gram(t, cols, F.col("y"))[()]
    # leave-one-out errors against refits without each row
    alphas = [0.1, 10.0, 1000.0]
    c, b = m - m.mean(0), v - v.mean()
    def loo(alpha):
        out = []
        for i in range(250):
            keep = np.arange(250) != i
            d, q = m[keep] - m[keep].mean(0), v[keep] - v[keep].mean()
            coef = np.linalg.solve(d.T @ d + alpha * np.eye(6), d.T @ q)
            out.append((v[i] - v[keep].mean() - (m[i] - m[keep].mean(0)) @ coef) ** 2)
        return np.mean(out)
    fit, alpha = L.ridge_loo(t, cols, F.col("y"), alphas)
    assert alpha == min(alphas, key=loo) and np.allclose(fit.coef, np.linalg.solve(c.T @ c + alpha * np.eye(6), c.T @ b))
    net, a, ratio = L.elastic_net_cv(folds, (0.5, 1.0))
    assert ratio in (0.5, 1.0) and abs(net.coef[1] + 2) < 0.1
    # orthogonal matching pursuit and least-angle order by hand
    def pursue(steps):
        chosen = []
        for _ in range(steps):
            left = b - (c[:, chosen] @ np.linalg.lstsq(c[:, chosen], b, rcond=None)[0] if chosen else 0)
            score = abs(c.T @ left) / np.sqrt((c**2).sum(0))
            score[chosen] = -1
            chosen.append(int(score.argmax()))
        return chosen
    assert L.omp(whole, 3) == pursue(3)
    order = L.lars(whole, 6)
    path = [f for _, f in L.lasso_path(whole, 200, 1e-4)]
    enters = [next(i for i, f in enumerate(path) if f.coef[j]) if any(f.coef[j] for f in path) else 999 for j in order[:3]]
    assert enters == sorted(enters) and sorted(order) == list(range(6))
    assert {0, 1, 2} <= set(L.forward_cv(folds)) and L.forward_cv(folds)[0] == L.forward(whole, 1)[0]
    for selector in ("lasso", "enet", "corr", "effect", "forward", "omp", "lars", L.tree_importance(t, names, F.col("y"), 5), L.mutual_information(t, names, "y")):
        e = L.selected(folds, 4, selector)
        assert 1 <= len(e.active()) <= 4
    assert L.selected(folds, 3, "effect").active() == ["c0", "c1", "c2"]
    corr = np.corrcoef(np.column_stack([m, v]).T)
    assert np.allclose(L.corr_matrix(whole), corr) and L.top_correlations(whole)[0][0] == names[int(abs(corr[:-1, -1]).argmax())]
    eq, share = L.stability_select(t, cols, F.col("y"), ["id"], 10, 0.8, 3)
    assert {"c1", "c2"} <= set(eq.active()) and share["c3"] < 0.8
    assert np.allclose(L.boosted_ridge(whole, 400, 0.5, 1.0).coef, L.ols(whole).coef, atol=0.05)
    assert L.subspace_ridge(whole, 20).coef[1] < -0.5
    assert L.prune_iterative(whole, L.ols(whole), 0.2).active() == ["c0", "c1", "c2"] and set(L.prune_mass(whole, L.ols(whole), 0.95).active()) >= {"c0", "c1"}
    assert "c3" not in L.sparse_bayes(whole).active()
    q = L.quantised(L.ols(whole), whole)
    assert whole.sse(q.coef, q.intercept) <= 1.005 * whole.sse(L.ols(whole).coef, L.ols(whole).intercept)
    assert all(round(x, 6) == x for x in L.priced_rounding(L.ols(whole), whole).coef)
    assert L.screen(t, names, F.col("y"), 2) == sorted(L.screen(t, names, F.col("y"), 2)) and len(L.screen(t, names, F.col("y"), 2)) == 2
    wild = t.withColumn("y", F.when(F.col("id") % 20 == 0, F.col("y") + 500).otherwise(F.col("y")))
    for e in (L.huber(wild, cols, F.col("y")), L.irls_mad(wild, cols, F.col("y"), 15)):
        assert abs(e.coef[1] + 2) < 0.3, e
    assert L.averaged([L.ols(whole), L.ridge(whole, 1e9)]).coef[1] == pytest.approx(L.ols(whole).coef[1] / 2, rel=1e-3)


def test_best_pair_by_exhaustion(spark):
    """Forward selection finds the best single column, and its pair is no worse than any with it."""
    rng = np.random.default_rng(2)
    m = rng.normal(size=(80, 5))
    v = m @ rng.normal(size=5)
    t = spark.createDataFrame([(*map(float, r), float(q)) for r, q in zip(m, v, strict=True)], ", ".join(f"c{i} double" for i in range(5)) + ", y double")
    whole = gram(t, {f"c{i}": F.col(f"c{i}") for i in range(5)}, F.col("y"))[()]
    sse = lambda keep: (lambda e: whole.sse(e.coef, e.intercept))(L.ols(whole, list(keep)))
    first, second = L.forward(whole, 2)
    assert first == min(range(5), key=lambda j: sse([j]))
    assert sse([first, second]) == pytest.approx(min(sse(p) for p in combinations(range(5), 2) if first in p))
