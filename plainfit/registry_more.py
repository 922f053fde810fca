"""Further registered queries: several regressors, fixed penalties, splits, boards and reports with SQL of their own, and the named models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import additive as G
from .operators import aggregate as A
from .operators import board as B
from .operators import curated
from .operators import inference as H
from .operators import linear as L
from .operators import prep as P
from .operators import tree as R
from .operators.model import linear_model, permutation_importance
from .plans.gram import fit_by, gram
from .registry import FEATURES, HELD_OUT, ORACLES, QUERIES, query, rounded, table

__all__ = ["ORACLES", "QUERIES"]

THREE = ["l_quantity", "l_discount", "l_tax"]

#: Least squares on three columns by residuals of each on the others: w1, w2, w3 and w0 are the weights of the rows in the
#: coefficients, h the leverages, e the residuals.
SQL_OLS = """
WITH m AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS m3, avg(l_extendedprice) AS my, count(*) AS n FROM lineitem),
c AS (SELECT l_suppkey AS g, l_quantity - m1 AS c1, l_discount - m2 AS c2, l_tax - m3 AS c3, l_extendedprice - my AS cy FROM lineitem, m),
s AS (SELECT sum(c1*c1) AS s11, sum(c1*c2) AS s12, sum(c1*c3) AS s13, sum(c2*c2) AS s22, sum(c2*c3) AS s23, sum(c3*c3) AS s33 FROM c),
r AS (SELECT g, c1, c2, c3, cy,
        c1 - (s12*s33 - s13*s23) / (s22*s33 - s23*s23) * c2 - (s13*s22 - s12*s23) / (s22*s33 - s23*s23) * c3 AS r1,
        c2 - (s12*s33 - s23*s13) / (s11*s33 - s13*s13) * c1 - (s23*s11 - s12*s13) / (s11*s33 - s13*s13) * c3 AS r2,
        c3 - (s13*s22 - s23*s12) / (s11*s22 - s12*s12) * c1 - (s23*s11 - s13*s12) / (s11*s22 - s12*s12) * c2 AS r3,
        c2 - s12 / s11 * c1 AS q2 FROM c, s),
t AS (SELECT sum(r1*r1) AS t1, sum(r2*r2) AS t2, sum(r3*r3) AS t3, sum(q2*q2) AS u2, sum(c1*c1) AS u1, sum(r1*cy)/sum(r1*r1) AS b1, sum(r2*cy)/sum(r2*r2) AS b2, sum(r3*cy)/sum(r3*r3) AS b3, sum(cy*cy) AS yy FROM r),
w AS (SELECT g, r1/t1 AS w1, r2/t2 AS w2, r3/t3 AS w3, 1.0/n - m1*r1/t1 - m2*r2/t2 - m3*r3/t3 AS w0, cy - b1*c1 - b2*c2 - b3*c3 AS e, 1.0/n + c1*c1/u1 + q2*q2/u2 + r3*r3/t3 AS h FROM r, t, m),
b AS (SELECT unnest(['intercept', 'l_quantity', 'l_discount', 'l_tax']) AS term, unnest([my - b1*m1 - b2*m2 - b3*m3, b1, b2, b3]) AS coef FROM t, m)"""


@query(
    SQL_OLS
    + """, v AS (
  SELECT 'plain' AS cov, sum(e*e)/(max(n)-4)*sum(w0*w0) AS v0, sum(e*e)/(max(n)-4)*sum(w1*w1) AS v1, sum(e*e)/(max(n)-4)*sum(w2*w2) AS v2, sum(e*e)/(max(n)-4)*sum(w3*w3) AS v3 FROM w, m
  UNION ALL SELECT 'HC3', sum(power(w0*e/(1-h), 2)), sum(power(w1*e/(1-h), 2)), sum(power(w2*e/(1-h), 2)), sum(power(w3*e/(1-h), 2)) FROM w
  UNION ALL SELECT 'cluster', a*sum(g0*g0), a*sum(g1*g1), a*sum(g2*g2), a*sum(g3*g3) FROM (SELECT sum(w0*e) AS g0, sum(w1*e) AS g1, sum(w2*e) AS g2, sum(w3*e) AS g3 FROM w GROUP BY g), (SELECT count(DISTINCT g)/(count(DISTINCT g)-1)*(count(*)-1)/(count(*)-4) AS a FROM w) GROUP BY a),
x AS (SELECT cov, unnest(['intercept', 'l_quantity', 'l_discount', 'l_tax']) AS term, unnest([v0, v1, v2, v3]) AS v FROM v)
SELECT cov, term, round(coef, 3) AS coef, round(sqrt(v), 4) AS se, round(coef / sqrt(v), 3) AS t, round((SELECT 1 - sum(e*e)/max(yy) FROM w, t), 8) AS r2 FROM x JOIN b USING (term)"""
)
def price_errors(spark, sf):
    """Least squares of line prices on three columns with plain, HC3 and supplier-clustered errors."""
    rows, out = table(spark, sf, "lineitem"), []
    for cov in ("plain", "HC3", "cluster"):
        terms, r2, _ = H.ols_inference(rows, "l_extendedprice", {c: F.col(c) for c in THREE}, cov, "l_suppkey")
        out += [(cov, n, float(b), float(se), float(t), float(r2)) for n, b, se, t, *_ in terms]
    found = spark.createDataFrame(out, "cov string, term string, coef double, se double, t double, r2 double")
    return rounded(rounded(rounded(found, "coef", "t", digits=3), "se", digits=4), "r2", digits=8)


#: Standardised moments of the three columns and the price, and a walk over the coordinates: round k moves column k % 3.
SQL_WALK = """
WITH RECURSIVE m AS (SELECT stddev_pop(l_quantity) AS d1, stddev_pop(l_discount) AS d2, stddev_pop(l_tax) AS d3, corr(l_quantity, l_discount) AS q12, corr(l_quantity, l_tax) AS q13, corr(l_discount, l_tax) AS q23,
  covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS r1, covar_pop(l_discount, l_extendedprice) / stddev_pop(l_discount) AS r2, covar_pop(l_tax, l_extendedprice) / stddev_pop(l_tax) AS r3 FROM lineitem),
w AS (SELECT 0 AS k, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3
  UNION ALL SELECT k + 1,
    CASE WHEN k % 3 = 0 THEN sign(r1 - q12*b2 - q13*b3) * greatest(abs(r1 - q12*b2 - q13*b3) - {l1}, 0) / (1 + {l2}) ELSE b1 END,
    CASE WHEN k % 3 = 1 THEN sign(r2 - q12*b1 - q23*b3) * greatest(abs(r2 - q12*b1 - q23*b3) - {l1}, 0) / (1 + {l2}) ELSE b2 END,
    CASE WHEN k % 3 = 2 THEN sign(r3 - q13*b1 - q23*b2) * greatest(abs(r3 - q13*b1 - q23*b2) - {l1}, 0) / (1 + {l2}) ELSE b3 END
  FROM w, m WHERE k < 300),
f AS (SELECT b1/d1 AS b1, b2/d2 AS b2, b3/d3 AS b3 FROM w, m WHERE k = 300)"""


@query(
    " UNION ALL ".join(
        f"SELECT * FROM ({SQL_WALK.format(l1=a * r, l2=a * (1 - r))} SELECT {i} AS path, unnest(['l_quantity', 'l_discount', 'l_tax']) AS term, round(unnest([b1, b2, b3]), 3) + 0.0 AS coef FROM f)" for i, (a, r) in enumerate([(50.0, 1.0), (20.0, 0.5), (0.5, 0.9)])
    )
)
def penalised_prices(spark, sf):
    """Lasso and elastic nets of fixed strength on three columns, from one moment job."""
    m = gram(table(spark, sf, "lineitem"), {c: F.col(c) for c in THREE}, F.col("l_extendedprice"))[()]
    out = [(i, c, round(float(b), 3) + 0.0) for i, (a, r) in enumerate([(50.0, 1.0), (20.0, 0.5), (0.5, 0.9)]) for c, b in zip(THREE, L.elastic_net(m, a, r).coef, strict=True)]
    return spark.createDataFrame(out, "path int, term string, coef double")


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, CAST(count(*) AS DOUBLE) AS n, round(sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / count(*)), 2) AS rmse FROM lineitem GROUP BY 1")
def fits_by_supplier(spark, sf):
    """A line for each supplier, solved in the executors."""
    found = fit_by(table(spark, sf, "lineitem"), {"l_quantity": F.col("l_quantity")}, F.col("l_extendedprice"), ["l_suppkey"], L.ols)
    return rounded(rounded(found.select("l_suppkey", F.col("coef")[0].alias("slope"), "intercept", "n", "rmse"), "slope", digits=3), "intercept", "rmse", digits=2)


@query(
    "WITH base AS (SELECT l_linenumber::DOUBLE AS a, l_quantity AS b0, CASE WHEN l_quantity <= 12 THEN 1.0::DOUBLE WHEN l_quantity <= 25 THEN 2.0 WHEN l_quantity <= 40 THEN 3.0 ELSE 4.0 END AS b, l_extendedprice - 25000 AS y FROM lineitem),"
    " cell AS (SELECT a, b, sum(y) AS y, count(*) AS n FROM base GROUP BY 1, 2), long AS (SELECT 'a' AS f, a AS x FROM cell UNION ALL SELECT 'b', b FROM cell),"
    " cut AS (SELECT f, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS t FROM (SELECT DISTINCT f, x AS v FROM long)),"
    " g1 AS (SELECT f, t, sum(y) FILTER (CASE f WHEN 'a' THEN a ELSE b END <= t) AS l, sum(n) FILTER (CASE f WHEN 'a' THEN a ELSE b END <= t) AS nl, sum(y) FILTER (CASE f WHEN 'a' THEN a ELSE b END > t) AS r, sum(n) FILTER (CASE f WHEN 'a' THEN a ELSE b END > t) AS nr FROM cell, cut WHERE t IS NOT NULL GROUP BY 1, 2),"
    " s1 AS (SELECT f, t FROM g1 ORDER BY l*l/nl + r*r/nr DESC LIMIT 1),"
    " sided AS (SELECT cell.*, CASE s1.f WHEN 'a' THEN a ELSE b END <= s1.t AS low FROM cell, s1),"
    " g2 AS (SELECT low, f, t, sum(y) FILTER (CASE f WHEN 'a' THEN a ELSE b END <= t) AS l, sum(n) FILTER (CASE f WHEN 'a' THEN a ELSE b END <= t) AS nl, sum(y) FILTER (CASE f WHEN 'a' THEN a ELSE b END > t) AS r, sum(n) FILTER (CASE f WHEN 'a' THEN a ELSE b END > t) AS nr FROM sided, cut WHERE t IS NOT NULL GROUP BY 1, 2, 3),"
    " s2 AS (SELECT low, f, t FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY l*l/nl + r*r/nr DESC) AS k FROM g2 WHERE nl > 0 AND nr > 0) WHERE k = 1),"
    " leaf AS (SELECT low, CASE s2.f WHEN 'a' THEN a ELSE b END <= s2.t AS low2, sum(y) AS y, sum(n) AS n FROM sided JOIN s2 USING (low) GROUP BY 1, 2)"
    " SELECT round(y / n + 25000, 3) AS pred, CAST(n AS BIGINT) AS n FROM leaf"
)
def tree_of_two(spark, sf):
    """A tree of depth two over line number and a coarse quantity: which columns are split, and where, is the tree's to find."""
    q = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("double").alias("a"), F.when(q <= 12, 1.0).when(q <= 25, 2.0).when(q <= 40, 3.0).otherwise(4.0).alias("b"), "l_extendedprice")
    tree = R.fit_tree(rows, ["a", "b"], F.col("l_extendedprice"), max_depth=2)
    return rounded(tree.transform(rows).groupBy("pred").agg(F.count(F.lit(1)).alias("n")), "pred", digits=3)


@query("SELECT 'l_linenumber' AS col, l_linenumber::DOUBLE AS level, count(*) AS n, 0.0::DOUBLE AS mean_residual FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_tax', l_tax, count(*), 0.0 FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_discount', l_discount, count(*), 0.0 FROM lineitem GROUP BY 2")
def backfitted_three(spark, sf):
    """Backfitting over three columns has met when the residuals' mean is 0 at every level of each."""
    cols = ["l_linenumber", "l_tax", "l_discount"]
    rows = table(spark, sf, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in cols), "l_extendedprice")
    scored = G.bin_gam(rows, cols, F.col("l_extendedprice"), bins=64, rounds=200).transform(rows).withColumn("e", F.col("l_extendedprice") - F.col("pred"))
    long = scored.select(F.inline(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("level"), "e") for c in cols))))
    return long.groupBy("col", "level").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("e"), 3) + 0.0).alias("mean_residual"))


@query("SELECT min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS n FROM (SELECT l_quantity, ntile(4) OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) AS k FROM lineitem) GROUP BY k")
def quantity_quarters(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_orderkey", "l_linenumber")
    out = A.ntile_label(rows, "l_quantity", ["l_orderkey", "l_linenumber"], ["q1", "q2", "q3", "q4"])
    return out.groupBy("label").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count(F.lit(1)).alias("n")).drop("label")


@query(
    "WITH z AS (SELECT l_returnflag, (l_extendedprice - avg(l_extendedprice) OVER w) / stddev_pop(l_extendedprice) OVER w AS z FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)) SELECT l_returnflag, 'l_extendedprice' AS \"column\", round(avg(z*z*z), 6) AS skewness, round(avg(z*z*z*z) - 3, 6) AS kurtosis FROM z GROUP BY 1"
)
def price_shapes(spark, sf):
    return rounded(A.shape_stats(table(spark, sf, "lineitem"), ["l_extendedprice"], ["l_returnflag"]), "skewness", "kurtosis")


@query("SELECT l_returnflag, round(avg(l_extendedprice) FILTER (l_linestatus = 'F'), 4) AS \"F\", round(avg(l_extendedprice) FILTER (l_linestatus = 'O'), 4) AS \"O\" FROM lineitem GROUP BY 1")
def pivoted_prices(spark, sf):
    return rounded(A.pivot_mean(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], "l_extendedprice"), "F", "O", digits=4)


@query(
    "SELECT * FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'label']) AS a, unnest([1.0, round(corr(l_quantity, l_discount), 8), round(corr(l_quantity, l_tax), 8), round(corr(l_quantity, l_extendedprice), 8)]) AS l_quantity, unnest([round(corr(l_quantity, l_discount), 8), 1.0, round(corr(l_discount, l_tax), 8), round(corr(l_discount, l_extendedprice), 8)]) AS l_discount, unnest([round(corr(l_quantity, l_tax), 8), round(corr(l_discount, l_tax), 8), 1.0, round(corr(l_tax, l_extendedprice), 8)]) AS l_tax, unnest([round(corr(l_quantity, l_extendedprice), 8), round(corr(l_discount, l_extendedprice), 8), round(corr(l_tax, l_extendedprice), 8), 1.0]) AS label FROM lineitem)"
)
def price_correlations(spark, sf):
    c = L.corr_matrix(gram(table(spark, sf, "lineitem"), {x: F.col(x) for x in THREE}, F.col("l_extendedprice"))[()])
    return spark.createDataFrame([(n, *(round(float(v), 8) for v in row)) for n, row in zip([*THREE, "label"], c, strict=True)], "a string, l_quantity double, l_discount double, l_tax double, label double")


@query("WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) - min(l_quantity) AS w, avg(l_discount) AS m, stddev_pop(l_discount) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / w, 9) AS l_quantity, round((l_discount - m) / s, 9) AS l_discount FROM lineitem, b")
def scaled_lines(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(P.Scaler(["l_discount"]).fit(rows).transform(P.Scaler(["l_quantity"], "minmax").fit(rows).transform(rows)), "l_quantity", "l_discount", digits=9)


#: Judges' scores by return flag (mode), line number (run), part (judge) and line status (dataset).
SQL_SCORES = "SELECT l_returnflag AS mode, l_linenumber AS run_id, l_partkey % 3 AS judge_id, l_linestatus AS dataset, l_quantity AS correctness, 100 * l_discount AS completeness, CASE WHEN l_tax > 0 THEN 100 * l_tax END AS clarity FROM lineitem"
SQL_SE = "round(CASE WHEN count(v) > 1 THEN stddev_samp(v) / sqrt(count(v)) ELSE 0 END, 6)"


@query(
    f"WITH s AS ({SQL_SCORES}), l AS (SELECT mode, run_id, judge_id, dataset, unnest(['correctness', 'completeness', 'clarity']) AS dimension, unnest([correctness, completeness, clarity]) AS v FROM s),"
    " r AS (SELECT mode, run_id, judge_id, dimension, avg(v) AS v FROM l GROUP BY ALL), o AS (SELECT mode, run_id, judge_id, 'overall' AS dimension, avg(v) AS v FROM r GROUP BY ALL)"
    f" SELECT mode, dataset, dimension, round(avg(v), 6) AS mean, {SQL_SE} AS se, count(v) AS n FROM l GROUP BY ALL UNION ALL SELECT mode, 'AVERAGE', dimension, round(avg(v), 6), {SQL_SE}, count(v) FROM (SELECT * FROM r UNION ALL SELECT * FROM o) GROUP BY ALL"
)
def judged_lines(spark, sf):
    """The judges' report over scores derived from the lines."""
    scores = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("run_id"), (F.col("l_partkey") % 3).alias("judge_id"), F.col("l_linestatus").alias("dataset"), F.col("l_quantity").alias("correctness"), (100 * F.col("l_discount")).alias("completeness"), F.when(F.col("l_tax") > 0, 100 * F.col("l_tax")).alias("clarity"))
    return rounded(B.judge_report(scores), "mean", "se")


@query(
    "WITH d AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag = 'R') AS d FROM lineitem GROUP BY 1) SELECT 'paired' AS test, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS statistic, CAST(count(d) - 1 AS DOUBLE) AS df, round(avg(d) / stddev_samp(d), 6) AS effect FROM d"
    " UNION ALL SELECT 'one_sample', round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6), CAST(count(*) - 1 AS DOUBLE), NULL FROM lineitem"
    " UNION ALL SELECT 'proportions', round((p1 - p2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 6), CAST(n1 + n2 AS DOUBLE), round(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)), 6) FROM (SELECT avg((l_linestatus = 'O')::INT) FILTER (l_discount > 0.05) AS p1, avg((l_linestatus = 'O')::INT) FILTER (l_discount <= 0.05) AS p2, avg((l_linestatus = 'O')::INT) AS p, count(*) FILTER (l_discount > 0.05) AS n1, count(*) FILTER (l_discount <= 0.05) AS n2 FROM lineitem)"
    " UNION ALL SELECT 'wilcoxon', (SELECT sum(rk) FROM (SELECT l_quantity - 25 AS d, rank() OVER (ORDER BY abs(l_quantity - 25)) + (count(*) OVER (PARTITION BY abs(l_quantity - 25)) - 1) / 2 AS rk FROM lineitem WHERE l_quantity <> 25) WHERE d > 0), (SELECT CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_quantity <> 25), NULL"
)
def more_tests(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("open", (F.col("l_linestatus") == "O").cast("int")).withColumn("high", (F.col("l_discount") > 0.05).cast("int"))
    pairs = ("l_suppkey", "l_returnflag", "l_quantity", "A", "R")
    paired, one, shares, signed = H.ttest_rel(rows, *pairs), H.ttest_1samp(rows, F.col("l_quantity"), 25.0), H.prop_ztest(rows, "open", "high", 1, 0), H.wilcoxon(rows, F.col("l_quantity") - 25)
    m = H.group_moments(rows, "open", "high", [1, 0])
    effects = {"paired": H.cohens_dz(rows, *pairs), "proportions": H.cohens_h(m[1][1], m[0][1])}
    out = [(n, round(float(t.statistic), 6), float(t.df), round(effects[n], 6) if n in effects else None) for n, t in (("paired", paired), ("one_sample", one), ("proportions", shares), ("wilcoxon", signed))]
    return spark.createDataFrame(out, "test string, statistic double, df double, effect double")


@query(
    "WITH RECURSIVE g AS (SELECT l_returnflag AS f, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM g WHERE f = 'A'), r AS (SELECT * FROM g WHERE f = 'R'), k AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m FROM g),"
    " t AS (SELECT abs(a.m - r.m) / sqrt(((a.n - 1) * a.v + (r.n - 1) * r.v) / (a.n + r.n - 2) * (1 / a.n + 1 / r.n)) AS t, a.n + r.n - 2 AS d FROM a, r),"
    # Simpson's rule on the density of Student's t between 0 and the statistic.
    " s AS (SELECT 1 - 2 * sum(t / 6000 * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((d + 1) / 2) - lgamma(d / 2) - ln(pi() * d) / 2 - (d + 1) / 2 * ln(1 + power(t * i / 2000, 2) / d))) AS p FROM t, (SELECT unnest(range(2001)) AS i)),"
    " f AS (SELECT (SELECT sum(g.n * power(g.m - k.m, 2)) FROM g) / 2 / ((SELECT sum((g.n - 1) * g.v) FROM g) / (k.n - 3)) AS f, k.n - 3 AS d FROM k),"
    " x AS (SELECT sum(power(c - e, 2) / e) AS x FROM (SELECT count(o_orderkey) AS c, p.n * s.n / (SELECT count(*) FROM orders) AS e FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) p CROSS JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) s LEFT JOIN orders o ON o.o_orderpriority = p.o_orderpriority AND o.o_orderstatus = s.o_orderstatus GROUP BY p.o_orderpriority, s.o_orderstatus, p.n, s.n))"
    " SELECT 'student' AS test, round(p, 6) AS p FROM s UNION ALL SELECT 'anova', round(power(1 + 2 * f / d, -d / 2), 6) FROM f UNION ALL SELECT 'chi2', round(exp(-x / 2) * (1 + x / 2 + power(x / 2, 2) / 2 + power(x / 2, 3) / 6), 6) FROM x"
)
def p_values(spark, sf):
    """p-values that SQL can give too: Student's by integration, F with two and chi-squared with eight degrees of freedom in closed form."""
    rows = table(spark, sf, "lineitem")
    found = {"student": H.ttest_ind(rows, "l_quantity", "l_returnflag", "A", "R"), "anova": H.anova_oneway(rows, "l_quantity", "l_returnflag"), "chi2": H.chi2_contingency(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")}
    return spark.createDataFrame([(n, round(float(t.p), 6)) for n, t in found.items()], "test string, p double")


#: Three experiments by order priority and return flag: errors of a fixed equation, facts of line tests, and a baseline in all.
SQL_BOARD = """
WITH perf AS (SELECT 'e' || l_linenumber % 3 AS experiment, l_linestatus AS dataset, CASE WHEN l_linenumber % 7 = 1 THEN 'base' ELSE 'm' || l_returnflag END AS model, sqrt(avg(power(l_extendedprice - 1500 * l_quantity, 2))) AS rmse FROM lineitem GROUP BY ALL),
facts AS (SELECT 'e' || l_linenumber % 3 AS experiment, CASE WHEN l_linenumber % 7 = 1 THEN 'base' ELSE 'm' || l_returnflag END AS model, CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END AS category, l_quantity > 25 AS passed FROM lineitem),
names AS (SELECT DISTINCT experiment, model, CASE model WHEN 'base' THEN 'baseline' ELSE 'c' || model END AS commit FROM perf),
ids AS (SELECT p.*, CASE n.commit WHEN 'baseline' THEN p.model ELSE p.experiment || '/' || n.commit || '/' || p.model END AS model_id FROM perf p JOIN names n USING (experiment, model)),
one AS (SELECT dataset, model_id, avg(rmse) AS rmse FROM ids GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY rmse) + (count(*) OVER (PARTITION BY dataset, rmse) - 1) / 2 AS r FROM one),
g AS (SELECT model_id, avg(r) AS mean_rank FROM rk GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT dataset) FROM perf)),
sc AS (SELECT experiment, model, avg(passed::INT) AS score, avg(passed::INT) FILTER (category = 'high') AS high, avg(passed::INT) FILTER (category = 'low') AS low FROM facts GROUP BY ALL),
b AS (SELECT g.model_id, min(experiment) AS experiment, any_value(model) AS model, any_value(mean_rank) AS mean_rank FROM g JOIN (SELECT DISTINCT model_id, experiment, model FROM ids) USING (model_id) GROUP BY 1)
"""


def experiments(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("e"), F.col("l_linenumber") % 3).alias("experiment"), F.col("l_linestatus").alias("dataset"), F.when(F.col("l_linenumber") % 7 == 1, "base").otherwise(F.concat(F.lit("m"), "l_returnflag")).alias("model"),
        F.col("l_extendedprice").alias("label"), (1500 * F.col("l_quantity")).alias("pred"), F.when(F.col("l_tax") > 0.04, "high").otherwise("low").alias("category"), (F.col("l_quantity") > 25).alias("passed"),
    )
    perf = A.rmse(rows, ["experiment", "dataset", "model"])
    overall = perf.select("experiment", "model").distinct().select("experiment", F.when(F.col("model") == "base", "baseline").otherwise(F.concat(F.lit("c"), "model")).alias("commit"), F.col("model").alias("model_name"), F.lit("derived").alias("description"), F.lit(None).cast("double").alias("mean_rank"))
    return perf, overall, rows.select("experiment", "model", "category", "passed")


@query(SQL_BOARD + "SELECT b.model_id, b.experiment, b.model AS model_name, round(b.mean_rank, 6) AS mean_rank_global, round(score, 6) AS dev_score, round(high, 6) AS dev_high, round(low, 6) AS dev_low, round(score, 6) AS test_score FROM b JOIN sc USING (experiment, model)")
def combined_board(spark, sf):
    """The leaderboard of three derived experiments: one baseline in all of them, categories, pooled ranks."""
    perf, overall, facts = experiments(spark, sf)
    board = B.combined_leaderboard(perf, overall, facts, facts, ["high", "low"])
    return rounded(board.select("model_id", "experiment", "model_name", "mean_rank_global", "dev_score", "dev_high", "dev_low", "test_score"), "mean_rank_global", "dev_score", "dev_high", "dev_low", "test_score")


@query(
    SQL_BOARD + ", f AS (SELECT b.model_id, b.model = 'base' AS base, b.mean_rank, score FROM b JOIN sc USING (experiment, model))"
    " SELECT model_id, base AND NOT EXISTS (SELECT 1 FROM f o WHERE o.base AND o.mean_rank <= f.mean_rank AND o.score >= f.score AND (o.mean_rank < f.mean_rank OR o.score > f.score)) AS on_baseline_front,"
    " NOT base AND NOT EXISTS (SELECT 1 FROM f o WHERE NOT o.base AND o.mean_rank <= f.mean_rank AND o.score >= f.score AND (o.mean_rank < f.mean_rank OR o.score > f.score)) AS on_evolved_front,"
    " NOT EXISTS (SELECT 1 FROM f o WHERE o.mean_rank <= f.mean_rank AND o.score >= f.score AND (o.mean_rank < f.mean_rank OR o.score > f.score)) AS on_combined_front,"
    " NOT base AND NOT EXISTS (SELECT 1 FROM f o WHERE o.base AND o.mean_rank <= f.mean_rank AND o.score >= f.score AND (o.mean_rank < f.mean_rank OR o.score > f.score)) AS beaten_by_no_baseline FROM f"
)
def frontier_flags(spark, sf):
    perf, overall, facts = experiments(spark, sf)
    board = B.combined_leaderboard(perf, overall, facts, facts, ["high", "low"])
    return B.frontier_report(board).select("model_id", "on_baseline_front", "on_evolved_front", "on_combined_front", "beaten_by_no_baseline")


@query("SELECT l_returnflag AS model, count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25) AS standard_passed, count(*) FILTER (l_linestatus = 'F') AS standard_tests, count(*) FILTER (l_linestatus = 'O' AND l_quantity > 25) AS hard_passed, count(*) FILTER (l_linestatus = 'O') AS hard_tests FROM lineitem GROUP BY 1")
def suites_of_lines(spark, sf):
    facts = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), F.when(F.col("l_linestatus") == "O", "hard_one").otherwise("one").alias("test"), (F.col("l_quantity") > 25).alias("passed"))
    return A.suite_counts(facts, ["hard"], ["model"])


@query(
    "WITH e AS (SELECT p_partkey, p_size / 50.0 AS p, (p_partkey % 10) / 20.0 AS c, (p_partkey % 5) / 4.0 AS a, p_partkey % 8 + 1 AS r, p_partkey % 3 = 0 AS z FROM part)"
    " SELECT p_partkey, round(CASE WHEN z AND p >= 0.05 AND c >= 0.05 AND r > 3 THEN 15 * a WHEN p < 0.05 AND c < 0.05 AND a >= 0.5 AND r <= 3 THEN 75 + 25 * a WHEN (p < 0.05 OR c < 0.05) AND a >= 0.5 THEN 40 + 30 * a ELSE 15 + 25 * a END, 2) AS score FROM e"
)
def evidence_of_parts(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("p"), ((k % 10) / 20.0).alias("p_controlled"), ((k % 5) / 4.0).alias("agreement"), (k % 8 + 1).alias("importance_rank"), (k % 3 == 0).alias("zeroed"))
    return H.evidence_score(rows).select("p_partkey", "score")


# -- fits without SQL --------------------------------------------------------------------------------------------------


def model_error(spark, sf, fit) -> DataFrame:
    """(n, rmse, r2) on the held-out rows of what ``fit`` learns on the others."""
    rows = table(spark, sf, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in [*FEATURES, "l_extendedprice", "l_orderkey"]), F.expr(HELD_OUT).alias("test"))
    y = F.col("l_extendedprice")
    scored = fit(rows.filter("not test"), y).transform(rows.filter("test"))
    gap = F.pow(y - F.col("pred"), 2)
    return rounded(scored.agg(F.count(gap).alias("n"), F.sqrt(F.avg(gap)).alias("rmse"), (1 - F.avg(gap) / F.var_pop(y)).alias("r2")), "rmse", "r2", digits=4)


def _register(name: str, fit) -> None:
    def run(spark, sf):
        return model_error(spark, sf, fit)

    run.__name__ = run.__qualname__ = name
    run.__doc__ = f"Held-out error of {name.removesuffix('_error')}."
    query()(run)


KEY = ["l_orderkey", "l_quantity", "l_linenumber"]
for _name in ("hinge_ebm", "hinge_gam", "smart_additive", "sparse_signed_basis_pursuit", "winsorized_sparse_ols", "tiny_tree", "hybrid_gam"):
    _register(f"{_name}_error", lambda rows, y, f=curated.MODELS[_name]: f(rows, FEATURES, y, KEY))


def _fold():
    return F.col("l_orderkey") % 3


def _held():
    return F.col("l_orderkey") % 7 == 0


for _name, _fit in {
    "piecewise_gam": lambda rows, y: G.piecewise_gam(rows, FEATURES, y, _fold(), interactions=2), "bin_ridge_gam": lambda rows, y: G.bin_ridge_gam(rows, FEATURES, y), "shape_trees": lambda rows, y: G.shape_trees(rows, FEATURES, y, _held()),
    "trunk_plus_terms": lambda rows, y: G.trunk_plus_terms(rows, FEATURES, y, _held()), "calibrated_score": lambda rows, y: G.calibrated_score(rows, FEATURES, y, _held()), "split_linear": lambda rows, y: G.split_linear(rows, FEATURES, y, _held()),
    "spline_gam": lambda rows, y: G.spline_gam(rows, FEATURES, y, _fold()), "fourier_ridge": lambda rows, y: G.fourier_ridge(rows, FEATURES, y, _fold(), 20), "model_tree": lambda rows, y: R.model_tree(rows, FEATURES, y),
    "tree_guided_linear": lambda rows, y: R.tree_guided_linear(rows, FEATURES, y, _fold()), "trunk_plus_stumps": lambda rows, y: R.trunk_plus_stumps(rows, FEATURES, y), "prototypes": lambda rows, y: R.prototypes(rows, FEATURES, y), "mini_boost": lambda rows, y: R.mini_boost(rows, FEATURES, y),
}.items():
    _register(f"{_name}_error", _fit)


@query()
def moved_columns(spark, sf):
    """Permutation importance of a linear model's columns on the held-out rows."""
    rows = table(spark, sf, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in [*FEATURES, "l_extendedprice"]), F.expr(HELD_OUT).alias("test"))
    model = linear_model(L.ols(gram(rows.filter("not test"), {c: F.col(c) for c in FEATURES}, F.col("l_extendedprice"))[()]))
    return rounded(permutation_importance(model, rows.filter("test"), FEATURES, F.col("l_extendedprice")), "rmse", "increase", digits=4)
