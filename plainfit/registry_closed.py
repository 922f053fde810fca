"""Registered queries whose SQL works out closed forms: formulas, exact ranks, counts with dispersion, robust errors, penalties, explanations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import additive as G
from .operators import aggregate as A
from .operators import formula as S
from .operators import glm as M
from .operators import grid as Q
from .operators import inference as H
from .operators import linear as L
from .operators import prep as P
from .operators import splines as N
from .operators import teacher as E
from .operators import tree as R
from .operators.model import effect_curve, honesty, linear_model, probe, toggle_effect
from .plans.gram import gram
from .registry import HELD_OUT, ORACLES, QUERIES, READABLE, query, rounded, table
from .registry_more import THREE

__all__ = ["ORACLES", "QUERIES"]

X, Y = "l_quantity", "l_extendedprice"


def effects(spark, rows, digits: int = 4) -> DataFrame:
    """(term, coef, se) of rows (term, coef, se, ...)."""
    return rounded(spark.createDataFrame([(r[0], float(r[1]), float(r[2])) for r in rows], "term string, coef double, se double"), "coef", "se", digits=digits)


# -- formulas ---------------------------------------------------------------------------------------------------------

BY_FLAG = f"SELECT l_returnflag AS f, count(*) AS n, avg({X}) AS mx, avg({Y}) AS my, regr_sxx({Y}, {X}) AS sxx, regr_sxy({Y}, {X}) AS sxy, regr_syy({Y}, {X}) AS syy, regr_slope({Y}, {X}) AS b, regr_intercept({Y}, {X}) AS a FROM lineitem GROUP BY 1"
FLAGS = "C(l_returnflag, Treatment('N'))"
SQL_FLAGS = FLAGS.replace("'", "''")


@query(
    f"WITH g AS ({BY_FLAG}), s AS (SELECT sum(syy - b * sxy) / (sum(n) - 2 * count(*)) AS v FROM g), r AS (SELECT * FROM g WHERE f = 'N')"
    " SELECT 'intercept' AS term, round(a, 4) AS coef, round(sqrt(v * (1 / n + mx * mx / sxx)), 4) AS se FROM r, s"
    f" UNION ALL SELECT '{X}', round(b, 4), round(sqrt(v / sxx), 4) FROM r, s"
    f" UNION ALL SELECT '{SQL_FLAGS}[T.' || g.f || ']', round(g.a - r.a, 4), round(sqrt(v * (1 / g.n + g.mx * g.mx / g.sxx + 1 / r.n + r.mx * r.mx / r.sxx)), 4) FROM g, r, s WHERE g.f <> 'N'"
    f" UNION ALL SELECT '{X}:{SQL_FLAGS}[T.' || g.f || ']', round(g.b - r.b, 4), round(sqrt(v * (1 / g.sxx + 1 / r.sxx)), 4) FROM g, r, s WHERE g.f <> 'N'"
)
def formula_effects(spark, sf):
    return effects(spark, S.ols(table(spark, sf, "lineitem"), f"{Y} ~ {X} * {FLAGS}")[0])


@query(
    f"WITH g AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, avg({Y}) AS m, sum({Y} * {Y}) - count(*) * avg({Y}) * avg({Y}) AS ss FROM lineitem GROUP BY 1, 2), v AS (SELECT sum(ss) / (sum(n) - count(*)) AS v FROM g)"
    " SELECT 'l_returnflag[' || f || ']:l_linestatus[' || s || ']' AS term, round(m, 3) AS coef, round(sqrt(v / n), 3) AS se FROM g, v"
)
def formula_cells(spark, sf):
    return effects(spark, S.ols(table(spark, sf, "lineitem"), f"{Y} ~ l_returnflag:l_linestatus - 1")[0], 3)


@query(
    f"WITH x AS (SELECT ln({Y}) AS y, ln(1 + {X}) AS x FROM lineitem), r AS (SELECT count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) AS v FROM x)"
    f" SELECT 'intercept' AS term, round(a, 6) AS coef, round(sqrt(v * (1 / n + mx * mx / sxx)), 6) AS se FROM r UNION ALL SELECT 'np.log1p({X})', round(b, 6), round(sqrt(v / sxx), 6) FROM r"
)
def formula_logs(spark, sf):
    return effects(spark, S.ols(table(spark, sf, "lineitem"), f"np.log({Y}) ~ np.log1p({X})")[0], 6)


@query(
    f"WITH g AS ({BY_FLAG}), t AS (SELECT count(*) AS n, regr_syy({Y}, {X}) - regr_slope({Y}, {X}) * regr_sxy({Y}, {X}) AS only_x FROM lineitem), w AS (SELECT count(*) AS k, sum(syy) AS only_f, sum(syy) - sum(sxy) * sum(sxy) / sum(sxx) AS added, sum(syy - b * sxy) AS crossed FROM g)"
    " SELECT 'l_returnflag' AS term, k - 1 AS df, round((only_x - added) / (k - 1) / (crossed / (n - 2 * k)), 4) AS f FROM t, w"
    f" UNION ALL SELECT '{X}', 1, round((only_f - added) / (crossed / (n - 2 * k)), 4) FROM t, w"
    f" UNION ALL SELECT 'l_returnflag:{X}', k - 1, round((added - crossed) / (k - 1) / (crossed / (n - 2 * k)), 4) FROM t, w"
)
def formula_anova(spark, sf):
    rows = S.anova(table(spark, sf, "lineitem"), f"{Y} ~ l_returnflag * {X}")
    return spark.createDataFrame([(r[0], int(r[1]), round(float(r[3]), 4)) for r in rows if r[0] != "residual"], "term string, df long, f double")


# -- tests ------------------------------------------------------------------------------------------------------------

NATIONS = "customer JOIN nation ON n_nationkey = c_nationkey"


@query(
    f"WITH m AS (SELECT n_regionkey AS r, n_name, avg(c_acctbal) AS v FROM {NATIONS} WHERE n_regionkey IN (0, 1) GROUP BY 1, 2), k AS (SELECT r, rank() OVER (ORDER BY v) AS rk FROM m),"
    " u AS (SELECT sum(rk) FILTER (r = 0) - count(*) FILTER (r = 0) * (count(*) FILTER (r = 0) + 1) / 2 AS u, count(*) FILTER (r = 0) AS a, count(*) AS n FROM k),"
    " e AS (SELECT list_sum(list_transform(range(n), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN i + 1 ELSE 0 END)) - a * (a + 1) / 2 AS s FROM u, range(1 << (SELECT n FROM u)) t(mask) WHERE bit_count(mask) = a),"
    " c AS (SELECT avg(CASE WHEN s >= u THEN 1.0 ELSE 0.0 END) AS above, avg(CASE WHEN s <= u THEN 1.0 ELSE 0.0 END) AS below FROM e, u),"
    f" d AS (SELECT n_name, avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') - avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS d FROM {NATIONS} GROUP BY 1), q AS (SELECT d, rank() OVER (ORDER BY abs(d)) AS rk FROM d WHERE d IS NOT NULL),"
    " w AS (SELECT coalesce(sum(rk) FILTER (d > 0), 0) AS w, count(*) AS n FROM q),"
    " p AS (SELECT list_reduce(list_prepend([1.0::DOUBLE], list_transform(range(1, n + 1), lambda i: [i::DOUBLE])), lambda acc, i: list_transform(range(1, len(acc) + i[1]::BIGINT + 1), lambda j: coalesce(acc[j], 0) / 2 + CASE WHEN j > i[1] THEN acc[j - i[1]::BIGINT] / 2 ELSE 0 END)) AS p FROM w)"
    " SELECT 'rank_sum' AS test, round(u, 6) AS statistic, round(least(1, 2 * least(above, below)), 8) AS p FROM u, c"
    " UNION ALL SELECT 'rank_sum_greater', round(u, 6), round(above, 8) FROM u, c"
    " UNION ALL SELECT 'signed_rank', round(w, 6), round(least(1, 2 * least(list_sum(p[w::BIGINT + 1:]), list_sum(p[:w::BIGINT + 1]))), 8) FROM w, p"
)
def exact_rank_tests(spark, sf):
    """Regions' and segments' mean balances by nation: samples small enough for counted null distributions."""
    known = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    means = known.groupBy("n_regionkey", "n_name").agg(F.avg("c_acctbal").alias("v"))
    of = lambda s: F.avg(F.when(F.col("c_mktsegment") == s, F.col("c_acctbal")))
    gaps = known.groupBy("n_name").agg((of("BUILDING") - of("MACHINERY")).alias("d"))
    found = {"rank_sum": H.mann_whitney(means, "v", "n_regionkey", 0, 1), "rank_sum_greater": H.mann_whitney(means, "v", "n_regionkey", 0, 1, "greater"), "signed_rank": H.wilcoxon(gaps, F.col("d"))}
    return spark.createDataFrame([(n, round(float(t.statistic), 6), round(float(t.p), 8)) for n, t in found.items()], "test string, statistic double, p double")


HIGH = "CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END"


def high():
    return {"high": (F.col("l_discount") > 0.05).cast("int")}


def finer(name: str, before: str, width: float) -> str:
    """The best of 201 logarithms of the dispersion within ``width`` of the best one before."""
    likelihood = "sum(n * (lgamma(y + exp(-c)) - lgamma(exp(-c)) - lgamma(y + 1) + y * ln(mu / (exp(-c) + mu)) - exp(-c) * ln(1 + exp(c) * mu)))"
    return f"{name} AS MATERIALIZED (SELECT arg_max(c, ll) AS c, max(ll) AS ll FROM (SELECT c, {likelihood} AS ll FROM m CROSS JOIN (SELECT {before} + {width} * (i - 100) / 100 AS c FROM range(201) t(i)) GROUP BY c))"


@query(
    f"WITH k AS (SELECT {HIGH} AS g, CAST(l_quantity AS DOUBLE) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(n * y) OVER (PARTITION BY g) / sum(n) OVER (PARTITION BY g) AS mu FROM k),"
    f" {finer('one', '0', 6.0)}, {finer('two', '(SELECT c FROM one)', 0.06)}, {finer('three', '(SELECT c FROM two)', 0.0006)},"
    " s AS (SELECT max(mu) FILTER (g = 0) AS m0, max(mu) FILTER (g = 1) AS m1, sum(n) FILTER (g = 0) AS n0, sum(n) FILTER (g = 1) AS n1 FROM m)"
    " SELECT 'intercept' AS term, round(ln(m0), 4) AS coef, round(sqrt((1 / m0 + exp(c)) / n0), 4) AS se FROM s, three"
    " UNION ALL SELECT 'high', round(ln(m1 / m0), 4), round(sqrt((1 / m0 + exp(c)) / n0 + (1 / m1 + exp(c)) / n1), 4) FROM s, three"
    " UNION ALL SELECT 'dispersion', round(exp(c), 4), NULL FROM three UNION ALL SELECT 'log_likelihood', round(ll, 3), NULL FROM three"
)
def negbin_effects(spark, sf):
    """Counts with a dispersion of greatest likelihood."""
    fit = M.negbin_ml(table(spark, sf, "lineitem"), F.col("l_quantity"), high())
    rows = [(e.name, round(e.coef, 4), round(e.se, 4)) for e in fit.effects] + [("dispersion", round(fit.dispersion, 4), None), ("log_likelihood", round(fit.log_likelihood, 3), None)]
    return spark.createDataFrame(rows, "term string, coef double, se double")


@query(
    f"WITH x AS (SELECT {HIGH} AS g, l_suppkey AS c, CAST(l_quantity AS DOUBLE) AS y FROM lineitem), m AS (SELECT *, avg(y) OVER (PARTITION BY g) AS mu FROM x),"
    " r AS (SELECT sum(y) FILTER (g = 0) AS s0, sum(y) FILTER (g = 1) AS s1, sum((y - mu) * (y - mu)) FILTER (g = 0) AS v0, sum((y - mu) * (y - mu)) FILTER (g = 1) AS v1, count(*) AS n FROM m),"
    " b AS (SELECT c, coalesce(sum(y - mu) FILTER (g = 0), 0) AS d0, coalesce(sum(y - mu) FILTER (g = 1), 0) AS d1 FROM m GROUP BY 1),"
    " w AS (SELECT sum(d0 * d0) AS w00, sum(d0 * d1) AS w01, sum(d1 * d1) AS w11, count(*) AS k FROM b)"
    " SELECT 'HC0' AS cov, 'intercept' AS term, round(sqrt(v0) / s0, 6) AS se FROM r UNION ALL SELECT 'HC0', 'high', round(sqrt(v0 / s0 / s0 + v1 / s1 / s1), 6) FROM r"
    " UNION ALL SELECT 'HC1', 'intercept', round(sqrt(v0 * n / (n - 2)) / s0, 6) FROM r UNION ALL SELECT 'HC1', 'high', round(sqrt((v0 / s0 / s0 + v1 / s1 / s1) * n / (n - 2)), 6) FROM r"
    " UNION ALL SELECT 'cluster', 'intercept', round(sqrt(w00 * k / (k - 1) * (n - 1) / (n - 2)) / s0, 6) FROM r, w"
    " UNION ALL SELECT 'cluster', 'high', round(sqrt((w00 / s0 / s0 - 2 * w01 / s0 / s1 + w11 / s1 / s1) * k / (k - 1) * (n - 1) / (n - 2)), 6) FROM r, w"
)
def robust_rates(spark, sf):
    """Poisson regression with errors from rows' and suppliers' scores."""
    rows, out = table(spark, sf, "lineitem"), []
    for cov in ("HC0", "HC1", "cluster"):
        out += [(cov, e.name, round(e.se, 6)) for e in M.glm(rows, F.col("l_quantity"), high(), "poisson", cov=cov, cluster=F.col("l_suppkey") if cov == "cluster" else None)]
    return spark.createDataFrame(out, "cov string, term string, se double")


@query(
    f"WITH x AS (SELECT {HIGH} AS g, count(*)::DOUBLE AS n, count(*) FILTER (l_quantity > 25)::DOUBLE AS a FROM lineitem GROUP BY 1), t AS (SELECT max(n) FILTER (g = 0) AS n0, max(n) FILTER (g = 1) AS n1, max(a) FILTER (g = 0) AS a0, max(a) FILTER (g = 1) AS a1 FROM x)"
    " SELECT 'intercept' AS term, round(ln(a0 / (n0 - a0)), 5) AS coef, round(sqrt(1 / a0 + 1 / (n0 - a0)), 5) AS se FROM t UNION ALL SELECT 'high', round(ln(a1 / (n1 - a1) / (a0 / (n0 - a0))), 5), round(sqrt(1 / a0 + 1 / (n0 - a0) + 1 / a1 + 1 / (n1 - a1)), 5) FROM t"
)
def share_effects(spark, sf):
    """Shares of suppliers' lines, with the numbers of lines as trials."""
    lines = table(spark, sf, "lineitem").withColumn("high", high()["high"])
    shares = lines.groupBy("l_suppkey", "high").agg(F.avg((F.col("l_quantity") > 25).cast("double")).alias("share"), F.count(F.lit(1)).alias("trials"))
    return effects(spark, [(e.name, e.coef, e.se) for e in M.glm(shares, F.col("share"), {"high": F.col("high")}, weight=F.col("trials"))], 5)


@query(
    f"WITH x AS (SELECT {HIGH} AS g, count(*)::DOUBLE AS n, CAST(sum(l_quantity) AS DOUBLE) AS s FROM lineitem GROUP BY 1), t AS (SELECT max(n) FILTER (g = 0) AS n0, max(n) FILTER (g = 1) AS n1, max(s) FILTER (g = 0) AS s0, max(s) FILTER (g = 1) AS s1 FROM x)"
    " SELECT 'intercept' AS term, round(ln(s0 / n0), 5) AS coef, round(sqrt(1 / s0), 5) AS se FROM t UNION ALL SELECT 'high', round(ln(s1 / n1 / (s0 / n0)), 5), round(sqrt(1 / s0 + 1 / s1), 5) FROM t"
)
def exposed_rates(spark, sf):
    """Suppliers' quantities with the logarithm of their lines as offset."""
    lines = table(spark, sf, "lineitem").withColumn("high", high()["high"])
    sums = lines.groupBy("l_suppkey", "high").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))
    return effects(spark, [(e.name, e.coef, e.se) for e in M.glm(sums, F.col("quantity"), {"high": F.col("high")}, "poisson", offset=F.log("lines"))], 5)


@query(
    f"WITH s AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM (SELECT l_discount + 0.01 AS w, {X} AS x, {Y} AS y FROM lineitem)),"
    f" c AS (SELECT l_discount + 0.01 AS w, {X} - mx AS x, {Y} - my AS y FROM lineitem, s), b AS (SELECT sum(w * x * y) / sum(w * x * x) AS b, sum(w * x * x) AS sxx FROM c), e AS (SELECT sum(w * (y - b * x) * (y - b * x)) AS sse FROM c, b)"
    f" SELECT 'intercept' AS term, round(my - b * mx, 3) AS coef, round(sqrt(sse / (n - 2) * (1 / sw + mx * mx / sxx)), 3) AS se FROM s, b, e UNION ALL SELECT '{X}', round(b, 3), round(sqrt(sse / (n - 2) / sxx), 3) FROM s, b, e"
)
def weighted_prices(spark, sf):
    rows = table(spark, sf, "lineitem")
    return effects(spark, S.ols(rows, f"{Y} ~ {X}", weight=F.col("l_discount") + 0.01)[0], 3)


@query(
    f"WITH c AS (SELECT corr({Y}, {X}) AS a, corr({Y}, l_discount) AS b, corr({X}, l_discount) AS c, corr({Y}, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS p FROM lineitem)"
    " SELECT 'partial' AS name, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 8) AS r FROM c UNION ALL SELECT 'point_biserial', round(p, 8) FROM c"
)
def conditional_correlations(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("double"))
    found = [("partial", H.partial_corr(rows, Y, X, ["l_discount"])), ("point_biserial", H.pearson(rows, Y, "returned").statistic)]
    return spark.createDataFrame([(n, round(float(r), 8)) for n, r in found], "name string, r double")


# -- linear models ----------------------------------------------------------------------------------------------------

#: Cross products of two columns about their means, and ridge by Cramer's rule for each penalty p.
TWO = f"WITH m AS (SELECT avg({X}) AS mx, avg(l_linenumber) AS mz, avg({Y}) AS my, count(*) AS n FROM lineitem), c AS (SELECT l_orderkey, {X} - mx AS x, l_linenumber - mz AS z, {Y} - my AS y FROM lineitem, m), s AS (SELECT sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy FROM c)"
PENALTIES = [1.0, 1e4, 1e6, 1e8]
RIDGES = f", r AS (SELECT p, ((zz + p) * xy - xz * zy) / ((xx + p) * (zz + p) - xz * xz) AS b, ((xx + p) * zy - xz * xy) / ((xx + p) * (zz + p) - xz * xz) AS d, (xx + p) * (zz + p) - xz * xz AS det, xx, xz, zz, xy, zy, yy FROM s, unnest([{', '.join(f'{p!r}::DOUBLE' for p in PENALTIES)}]) t(p))"


def two(rows: DataFrame) -> dict:
    return {c: F.col(c) for c in (X, "l_linenumber")}


@query(
    TWO + RIDGES + ", g AS (SELECT p, n * (yy - 2 * (b * xy + d * zy) + b * b * xx + 2 * b * d * xz + d * d * zz) / power(n - 1 - (xx * (zz + p) - 2 * xz * xz + zz * (xx + p)) / det, 2) AS score FROM r, m)"
    f" SELECT 'fixed' AS kind, p AS alpha, round(b, 6) AS quantity, round(d, 6) AS line, round(my - b * mx - d * mz, 4) AS intercept FROM r, m WHERE p = 1e6"
    " UNION ALL SELECT 'gcv', p, round(b, 6), round(d, 6), round(my - b * mx - d * mz, 4) FROM r, m WHERE p = (SELECT arg_min(p, score) FROM g)"
    f" UNION ALL SELECT 'loo', p, round(b, 6), round(d, 6), round(my - b * mx - d * mz, 4) FROM r, m WHERE p = (SELECT arg_min(p, e) FROM (SELECT p, avg(power((c.y - b * c.x - d * c.z) / (1 - 1 / n - (c.x * c.x * (zz + p) - 2 * c.x * c.z * xz + c.z * c.z * (xx + p)) / det), 2)) AS e FROM c CROSS JOIN r CROSS JOIN m GROUP BY p))"
)
def ridge_prices(spark, sf):
    """Ridge with a given penalty, and with those of generalised and leave-one-out cross-validation."""
    rows = table(spark, sf, "lineitem")
    m = gram(rows, two(rows), F.col(Y))[()]
    fits = {"fixed": (L.ridge(m, 1e6), 1e6), "gcv": L.ridge_gcv(m, PENALTIES), "loo": L.ridge_loo(rows, two(rows), F.col(Y), PENALTIES)}
    return spark.createDataFrame([(k, a, round(float(e.coef[0]), 6), round(float(e.coef[1]), 6), round(float(e.intercept), 4)) for k, (e, a) in fits.items()], "kind string, alpha double, quantity double, line double, intercept double")


@query(
    f"WITH s AS (SELECT l_orderkey % 5 AS f, count(*)::DOUBLE AS n, CAST(sum({X}) AS DOUBLE) AS x, CAST(sum({Y}) AS DOUBLE) AS y, CAST(sum({X} * {X}) AS DOUBLE) AS xx, CAST(sum({X} * {Y}) AS DOUBLE) AS xy FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM s),"
    " b AS (SELECT f, ((t.xy - s.xy) - (t.x - s.x) * (t.y - s.y) / (t.n - s.n)) / ((t.xx - s.xx) - (t.x - s.x) * (t.x - s.x) / (t.n - s.n)) AS b, (t.x - s.x) / (t.n - s.n) AS mx, (t.y - s.y) / (t.n - s.n) AS my FROM s, t)"
    f" SELECT round(avg(power({Y} - my - b * ({X} - mx), 2)), 1) AS mse FROM lineitem JOIN b ON f = l_orderkey % 5"
)
def folded_error(spark, sf):
    """Cross-validated error of least squares from the moments of the folds alone."""
    rows = table(spark, sf, "lineitem").withColumn("fold", F.col("l_orderkey") % 5)
    folds = gram(rows, {X: F.col(X)}, F.col(Y), ["fold"])
    return spark.createDataFrame([(round(L.cross_validated(folds, L.ols), 1),)], "mse double")


@query(
    f"WITH q AS (SELECT quantile_cont({X}, 0.05) AS lo, quantile_cont({X}, 0.95) AS hi FROM lineitem), x AS (SELECT least(greatest({X}, lo), hi) AS x, {Y} AS y FROM lineitem, q)"
    " SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 8) AS r2 FROM x"
)
def winsorised_fit(spark, sf):
    rows = P.Winsorizer([X], 0.05, 0.95).fit(table(spark, sf, "lineitem")).transform(table(spark, sf, "lineitem"))
    m = gram(rows, {X: F.col(X)}, F.col(Y))[()]
    e, (_, _, _, total, _) = L.ols(m), m.centered()
    return spark.createDataFrame([(round(float(e.coef[0]), 6), round(float(e.intercept), 4), round(1 - m.sse(e.coef, e.intercept) / total, 8))], "slope double, intercept double, r2 double")


# -- bases and explanations -------------------------------------------------------------------------------------------


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN 1e0 ELSE 0e0 END AS low, CASE WHEN l_quantity > 10 AND l_quantity <= 30 THEN 1e0 ELSE 0e0 END AS middle, CASE WHEN l_quantity > 30 THEN 1e0 ELSE 0e0 END AS high,"
    " round(l_quantity * l_quantity, 6) AS square, round(l_quantity * l_discount, 6) AS product, round(sin(l_quantity), 6) AS wave, round(exp(-abs(l_discount)), 6) AS decay FROM lineitem"
)
def basis_columns(spark, sf):
    rows = table(spark, sf, "lineitem")
    low, middle, top = C.binned(F.col("l_quantity"), [10.0, 30.0])
    poly = C.poly2(["l_quantity", "l_discount"])
    out = rows.select("l_orderkey", "l_linenumber", low.alias("low"), middle.alias("middle"), top.alias("high"), poly["l_quantity^2"].alias("square"), poly["l_quantity*l_discount"].alias("product"), F.sin("l_quantity").alias("wave"), F.exp(-F.abs("l_discount")).alias("decay"))
    return rounded(out, "square", "product", "wave", "decay")


@query("WITH x AS (" + " UNION ALL ".join(f"SELECT '{t.text()}' AS term, {t.coef!r}::DOUBLE * ({t.sql()}) AS part FROM lineitem" for t in READABLE.terms) + "), m AS (SELECT term, part, avg(part) OVER (PARTITION BY term) AS mean FROM x), i AS (SELECT term, avg(abs(part - mean)) AS importance FROM m GROUP BY 1) SELECT term, round(importance, 6) AS importance, round(importance / sum(importance) OVER (), 8) AS share FROM i")
def term_importance(spark, sf):
    return rounded(rounded(READABLE.importance(table(spark, sf, "lineitem")), "importance"), "share", digits=8)


@query(" UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{t.text()}' AS term, round({t.coef!r}::DOUBLE * ({t.sql()}), 6) + 0e0 AS part FROM lineitem" for t in READABLE.terms))
def term_contributions(spark, sf):
    parts = rounded(READABLE.contributions(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]), "part")
    return parts.withColumn("part", F.col("part") + 0.0)  # one zero only


@query(f"WITH x AS (SELECT {READABLE.sql()} AS card, {READABLE.sql()} + CASE WHEN l_linenumber = 1 THEN 10 ELSE 0 END AS batch FROM lineitem) SELECT round(power(corr(card, batch), 2), 8) AS r2, round(max(abs(card - batch)), 6) AS max_gap FROM x")
def card_honesty(spark, sf):
    """A batch prediction that adds 10 to first lines against the printed equation."""
    batch = READABLE.column() + F.when(F.col("l_linenumber") == 1, 10.0).otherwise(0.0)
    return rounded(rounded(honesty(table(spark, sf, "lineitem"), READABLE.column(), batch), "r2", digits=8), "max_gap")


def with_value(column: str, value: str) -> str:
    return READABLE.sql().replace(f'"{column}"', value)


@query(f"SELECT round(avg(({with_value('l_discount', '1e0')}) - ({with_value('l_discount', '0e0')})), 6) AS effect FROM lineitem")
def discount_toggle(spark, sf):
    return rounded(toggle_effect(READABLE, table(spark, sf, "lineitem"), "l_discount"), "effect")


@query(
    f"WITH q AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, quantile_disc(l_discount, 0.5) AS d, quantile_disc(l_tax, 0.5) AS t FROM lineitem), g AS (SELECT lo + i * (hi - lo) / 11e0 AS l_quantity, d AS l_discount, t AS l_tax FROM q, range(12) r(i))"
    f" SELECT round(l_quantity, 6) AS l_quantity, round({READABLE.sql()}, 6) AS pred FROM g"
)
def quantity_curve(spark, sf):
    return rounded(effect_curve(READABLE, table(spark, sf, "lineitem"), THREE, "l_quantity", 12), "l_quantity", "pred")


@query(
    f"WITH p AS (SELECT l_returnflag, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM lineitem GROUP BY 1), s AS (SELECT l_returnflag, {READABLE.sql()} AS pred FROM p)"
    " SELECT l_returnflag, round(pred, 6) AS pred, round(pred - (SELECT arg_min(pred, l_returnflag) FROM s), 6) AS difference FROM s"
)
def probed_flags(spark, sf):
    means = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*(F.avg(c).alias(c) for c in THREE))
    return rounded(probe(READABLE, means, "l_returnflag").select("l_returnflag", "pred", "difference"), "pred", "difference")


# -- plumbing ---------------------------------------------------------------------------------------------------------


@query(f"WITH m AS (SELECT avg({Y}) AS m, stddev_pop({Y}) AS s FROM lineitem WHERE NOT ({HELD_OUT})) SELECT l_orderkey, l_linenumber, {HELD_OUT} AS test, round(({Y} - m) / s, 8) AS price FROM lineitem, m")
def normalised_prices(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(HELD_OUT).alias("test"), F.col(Y).alias("price"))
    return rounded(P.normalize_label(rows.filter("not test"), rows.filter("test"), "price")[0].unionByName(P.normalize_label(rows.filter("not test"), rows.filter("test"), "price")[1]), "price", digits=8)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY abs(l_extendedprice) DESC, l_orderkey * 10 + l_linenumber LIMIT 25")
def dearest_lines(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.top_by_size(rows, "l_extendedprice", 25, "key").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("WITH t AS (SELECT n_name, sum(c_acctbal) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), r AS (SELECT *, coalesce(sum(abs(v)) OVER (ORDER BY abs(v) DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(abs(v)) OVER () AS b FROM t) SELECT n_name, round(v, 2) AS v FROM r WHERE b < 0.5")
def half_of_balances(spark, sf):
    sums = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.sum("c_acctbal").alias("v"))
    return rounded(A.mass_select(sums, "v", 0.5, 1).select("n_name", "v"), "v", digits=2)


@query(
    "WITH h AS (SELECT 'quantity' AS feature, CAST(l_quantity AS INTEGER) AS bin, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 2 UNION ALL SELECT 'line', l_linenumber, count(*), sum(l_extendedprice) FROM lineitem GROUP BY 2),"
    " c AS (SELECT feature, bin, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY feature) AS n, sum(s) OVER (PARTITION BY feature) AS s FROM h WINDOW w AS (PARTITION BY feature ORDER BY bin)),"
    " g AS (SELECT feature, bin, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM c WHERE nl >= 20 AND n - nl >= 20) SELECT feature, arg_max(bin, gain) AS bin FROM g GROUP BY 1"
)
def first_splits(spark, sf):
    rows = table(spark, sf, "lineitem")
    hist = lambda name, bin_: rows.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(Y).alias("s")).select(F.lit(name).alias("feature"), "bin", "n", "s")
    return A.best_split(hist("quantity", F.col("l_quantity")).unionByName(hist("line", F.col("l_linenumber"))), 20).select("feature", "bin")


SMOOTH = "SELECT bin, CASE WHEN lag(value) OVER w IS NULL OR lead(value) OVER w IS NULL THEN value ELSE 0.2 * lag(value) OVER w + 0.6 * value + 0.2 * lead(value) OVER w END AS value FROM {} WINDOW w AS (ORDER BY bin)"


@query(
    "WITH s0 AS (SELECT CAST(l_quantity AS INTEGER) AS bin, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1), "
    + ", ".join(f"s{i + 1} AS ({SMOOTH.format(f's{i}')})" for i in range(3))
    + ", f AS (SELECT bin, (6 * value + 4 * coalesce(lag(value) OVER w, 0) + 4 * coalesce(lead(value) OVER w, 0) + coalesce(lag(value, 2) OVER w, 0) + coalesce(lead(value, 2) OVER w, 0)) / (6 + CASE WHEN lag(value) OVER w IS NULL THEN 0 ELSE 4 END + CASE WHEN lead(value) OVER w IS NULL THEN 0 ELSE 4 END + CASE WHEN lag(value, 2) OVER w IS NULL THEN 0 ELSE 1 END + CASE WHEN lead(value, 2) OVER w IS NULL THEN 0 ELSE 1 END) AS five FROM s0 WINDOW w AS (ORDER BY bin))"
    " SELECT bin, round(value, 4) AS three, round(five, 4) AS five FROM s3 JOIN f USING (bin)"
)
def smoothed_shape(spark, sf):
    shape = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("bin")).agg(F.avg(Y).alias("value")).withColumn("feature", F.lit("quantity"))
    three, five = A.smooth(shape).select("bin", F.col("value").alias("three")), A.smooth_five(shape).select("bin", F.col("value").alias("five"))
    return rounded(three.join(five, "bin"), "three", "five", digits=4)


# -- splines and shapes -----------------------------------------------------------------------------------------------

#: Cubic pieces of a basis function by the distance u from where its support begins, in spaces between knots.
CUBIC = "CASE WHEN u < 0 OR u >= 4 THEN 0 WHEN u < 1 THEN u * u * u / 6 WHEN u < 2 THEN (-3 * (u - 1) * (u - 1) * (u - 1) + 3 * (u - 1) * (u - 1) + 3 * (u - 1) + 1) / 6 WHEN u < 3 THEN (3 * (u - 2) * (u - 2) * (u - 2) - 6 * (u - 2) * (u - 2) + 4) / 6 ELSE (4 - u) * (4 - u) * (4 - u) / 6 END"


@query(
    f"WITH r AS (SELECT *, row_number() OVER () AS r FROM lineitem), d AS (SELECT r, l_orderkey, l_linenumber, j, (least(greatest(l_quantity, 5), 45) - 5) / 8e0 - (j - 3) AS u FROM r CROSS JOIN range(8) t(j)), b AS (SELECT r, l_orderkey, l_linenumber, j, {CUBIC} AS v FROM d)"
    " SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, round(max(v) FILTER (j = 0), 8) AS first, round(max(v) FILTER (j = 4), 8) AS fifth, round(max(v) FILTER (j = 7), 8) AS last, round(sum(v), 8) AS total FROM b GROUP BY r"
)
def spline_bases(spark, sf):
    """Three of eight cubic basis functions over quantities from 5 to 45, and what all add up to."""
    terms = N.bases("l_quantity", 5.0, 45.0, 8)
    out = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", terms[0].column().alias("first"), terms[4].column().alias("fifth"), terms[7].column().alias("last"), sum((t.column() for t in terms[1:]), terms[0].column()).alias("total"))
    return rounded(out, "first", "fifth", "last", "total", digits=8)


@query("SELECT l_linenumber, round(avg(l_extendedprice), 3) AS pred FROM lineitem GROUP BY 1")
def spline_lines(spark, sf):
    """Splines without penalty, as many as there are line numbers, go through the means."""
    rows = table(spark, sf, "lineitem")
    model = N.spline_gam(rows, ["l_linenumber"], F.col(Y), 7, 3, (0.0,))
    return rounded(model.transform(rows).groupBy("l_linenumber").agg(F.max("pred").alias("pred")), "pred", digits=3)


GIVEN = N.SplineModel([N.Term("spline", "l_quantity", float(10 * (-1) ** j * (j + 1)), knot=t.knot, direction=t.direction, high=t.high, bounds=t.bounds) for j, t in enumerate(N.bases("l_quantity", 1.0, 50.0, 6, 2))], 7.0)


@query(f"SELECT l_orderkey, l_linenumber, round({GIVEN.sql()}, 6) AS pred FROM lineitem")
def spline_scores(spark, sf):
    return rounded(GIVEN.transform(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", "l_linenumber", "pred"), "pred")


DRAWN = sorted(np.random.default_rng(42).permutation(8)[:4].tolist())


@query(
    f"WITH m AS (SELECT avg({Y}) AS m FROM lineitem), g AS (SELECT l_linenumber AS b, count(*) AS n, sum({Y} - m) AS s FROM lineitem, m WHERE l_orderkey % 8 IN ({', '.join(map(str, DRAWN))}) GROUP BY 1),"
    " c AS (SELECT b, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM g WINDOW w AS (ORDER BY b)), k AS (SELECT arg_max(b, sl * sl / nl + (s - sl) * (s - sl) / (n - nl)) AS b FROM c WHERE nl >= 5 AND n - nl >= 5),"
    " f AS (SELECT c.b, sl / nl AS l, (s - sl) / (n - nl) AS r FROM c JOIN k ON c.b = k.b), e AS (SELECT avg(CASE WHEN l_linenumber <= f.b THEN l ELSE r END) AS e FROM lineitem, f)"
    " SELECT l_linenumber, round(any_value(m + CASE WHEN l_linenumber <= f.b THEN l ELSE r END - e), 4) AS pred FROM lineitem, m, f, e GROUP BY 1"
)
def subsampled_stump(spark, sf):
    """The first round of boosting on half of the rows' parts, in full."""
    rows = table(spark, sf, "lineitem")
    model = G.stochastic_gam(rows, ["l_linenumber"], F.col(Y), F.col("l_orderkey") % 8, F.lit(False), 8, 0.5, rounds=1, rate=1.0, edges=[[float(k) for k in range(1, 7)]])
    return rounded(model.transform(rows).groupBy("l_linenumber").agg(F.max("pred").alias("pred")), "pred", digits=4)


STEPS = G.ShapeModel([N.Term("step", "l_extendedprice", float((i * 37) % 101 - 50), knot=100.0 * i + 50) for i in range(1000)] + [N.Term("linear", "l_quantity", 2.0)], 3.0)


@query(
    "SELECT l_orderkey, l_linenumber, round(3 + 2 * l_quantity + coalesce((SELECT sum((i * 37) % 101 - 50) FROM range(1000) t(i) WHERE l_extendedprice > 100 * i + 50), 0), 6) AS pred FROM lineitem"
)
def long_shape_scores(spark, sf):
    """A shape of a thousand steps, found by halving."""
    return rounded(STEPS.transform(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "pred"), "pred")


# -- grids and trees --------------------------------------------------------------------------------------------------

QUARTERS = "CASE WHEN l_quantity <= 12 THEN 0 WHEN l_quantity <= 25 THEN 1 WHEN l_quantity <= 38 THEN 2 ELSE 3 END"


@query(
    f"WITH r AS (SELECT l_returnflag AS d, {HELD_OUT} AS t, {X} AS x, {QUARTERS} AS q, {Y} AS y FROM lineitem), f AS (SELECT d, avg(y) AS m, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r WHERE NOT t GROUP BY 1), g AS (SELECT d, q, avg(y) AS m FROM r WHERE NOT t GROUP BY 1, 2),"
    " e AS (SELECT r.d, count(*) AS n, sqrt(avg(power(y - a - b * x, 2))) AS line, sqrt(avg(power(y - f.m, 2))) AS mean, sqrt(avg(power(y - g.m, 2))) AS bins FROM r JOIN f ON f.d = r.d JOIN g ON g.d = r.d AND g.q = r.q WHERE t GROUP BY 1)"
    " SELECT d AS dataset, 'line' AS model, n, round(line, 4) AS rmse FROM e UNION ALL SELECT d, 'mean', n, round(mean, 4) FROM e UNION ALL SELECT d, 'bins', n, round(bins, 4) FROM e"
)
def grid_errors(spark, sf):
    """Three models on three datasets, from one moment job and one binned job."""
    rows = table(spark, sf, "lineitem")
    found = Q.moment_grid(rows, "l_returnflag", F.expr(HELD_OUT), [X], F.col(Y), {"line": L.ols, "mean": lambda m: L.ols(m, [])}, {"bins": Q.bin_means}, edges=[[12.0, 25.0, 38.0]])
    return rounded(found.select("dataset", "model", "n", "rmse"), "rmse", digits=4)


@query(
    f"WITH r AS (SELECT l_orderkey % 4 AS f, {X} AS x, {Y} AS y FROM lineitem), m AS (SELECT k AS f, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r CROSS JOIN range(4) t(k) WHERE r.f <> k GROUP BY 1)"
    " SELECT CAST(r.f AS INTEGER) AS fold, count(*) AS n, round(sqrt(avg(power(y - a - b * x, 2))), 4) AS rmse FROM r JOIN m ON m.f = r.f GROUP BY 1"
)
def fold_errors(spark, sf):
    rows = table(spark, sf, "lineitem")
    fit = lambda d: linear_model(L.ols(gram(d, {X: F.col(X)}, F.col(Y))[()]))
    return rounded(E.cross_validated_error(rows, fit, F.col(Y), F.col("l_orderkey") % 4, 4), "rmse", digits=4)


@query(
    "WITH g AS (SELECT l_linenumber AS b, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1), c AS (SELECT b, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM g WINDOW w AS (ORDER BY b)),"
    " k AS (SELECT arg_max(b, sl * sl / nl + (s - sl) * (s - sl) / (n - nl)) AS b FROM c WHERE nl < n), f AS (SELECT c.b, s / n AS root, sl / nl AS l, (s - sl) / (n - nl) AS r, n FROM c JOIN k ON c.b = k.b),"
    " t AS (SELECT b, avg(l_tax) FILTER (l_linenumber <= b) AS l, avg(l_tax) FILTER (l_linenumber > b) AS r FROM lineitem, f GROUP BY 1)"
    " SELECT 'shrunk' AS kind, l_linenumber, round(any_value(root + (CASE WHEN l_linenumber <= f.b THEN f.l ELSE f.r END - root) / (1 + 500 / n)), 6) AS value FROM lineitem, f GROUP BY 2"
    " UNION ALL SELECT 'recalibrated', l_linenumber, round(any_value(CASE WHEN l_linenumber <= f.b THEN t.l ELSE t.r END), 6) FROM lineitem, f, t GROUP BY 2"
    " UNION ALL SELECT 'pruned', l_linenumber, round(any_value(root), 6) FROM lineitem, f GROUP BY 2"
)
def tuned_stump(spark, sf):
    """A tree of one split, shrunk, recalibrated on another label, and pruned to its root."""
    rows = table(spark, sf, "lineitem")
    tree = R.fit_tree(rows, ["l_linenumber"], F.col("l_quantity"), max_depth=1)
    out = None
    for kind, made in (("shrunk", R.shrink(tree, 500.0)), ("recalibrated", R.recalibrate(tree, rows, F.col("l_tax"))), ("pruned", R.prune_ccp(tree, 1e9))):
        one = made.transform(rows).groupBy("l_linenumber").agg(F.max("pred").alias("value")).select(F.lit(kind).alias("kind"), "l_linenumber", F.round("value", 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
