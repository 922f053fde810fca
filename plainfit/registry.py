"""All registered queries of the library proper, over the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import additive as G
from .operators import aggregate as A
from .operators import board as B
from .operators import glm as M
from .operators import inference as H
from .operators import linear as L
from .operators import prep as P
from .operators import teacher as E
from .operators import tree as R
from .operators.model import Term, TermModel, linear_model
from .plans.bins import binned
from .plans.gram import gram
from .sources import tables as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: A test row by integer arithmetic, so that SQL can tell the same rows apart.
HELD_OUT = "(l_orderkey * 31 + l_linenumber) % 5 = 0"
READABLE = TermModel(
    [Term("linear", "l_quantity", 1500.0), Term("hinge", "l_quantity", -20.5, knot=25.0), Term("hinge", "l_quantity", 12.25, knot=10.0, direction=-1), Term("step", "l_discount", -300.0, knot=0.05), Term("square", "l_tax", 2500.0, knot=0.04), Term("kink", "l_discount", 75.0, knot=0.03), Term("interact", "l_quantity", 40.0, "l_discount"), Term("gate", "l_tax", -3.5, "l_quantity", knot=0.02)],
    150.0,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return S.read_table(spark, f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


# -- cleaning, derivation, splits -------------------------------------------------------------------------------------


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN lower(trim(event_type)) IN ('click', 'purchase') THEN 1 ELSE 0 END AS flag, round(CASE WHEN value < 0 THEN -1 ELSE 1 END * sqrt(abs(value)), 6) AS root, round(least(greatest(value, 1.0), 50.0), 6) AS held FROM events")
def prep_events(spark, sf):
    df = P.to_numeric(table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k")), ["k"])
    return rounded(df.select("event_id", "k", C.flag(F.col("event_type"), ["click", "purchase"]).alias("flag"), F.when(F.col("value").isNotNull(), C.signed_sqrt(F.col("value"))).alias("root"), C.clip(F.col("value"), 1, 50).alias("held")), "root", "held")


@query("WITH m AS (SELECT quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem WHERE (l_orderkey * 31 + l_linenumber) % 5 <> 0) SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_quantity > 5 THEN l_extendedprice END, m), 6) AS price FROM lineitem, m")
def median_imputed_prices(spark, sf):
    rows = table(spark, sf, "lineitem")
    imputer = P.MedianImputer(["l_extendedprice"]).fit(rows.filter(f"not ({HELD_OUT})"))
    holes = rows.withColumn("l_extendedprice", F.when(F.col("l_quantity") > 5, F.col("l_extendedprice")))
    return imputer.transform(holes).select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 6).alias("price"))


@query(ORACLES["median_imputed_prices"])
def median_imputed_lines(spark, sf):
    return median_imputed_prices(spark, sf)


@query("WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem) SELECT l_returnflag, round(avg(least(greatest(l_extendedprice, lo), hi)), 4) AS mean, round(min(greatest(l_extendedprice, lo)), 4) AS low FROM lineitem, b GROUP BY 1")
def winsorised_prices(spark, sf):
    rows = table(spark, sf, "lineitem")
    out = P.Winsorizer(["l_extendedprice"]).fit(rows).transform(rows)
    return rounded(out.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"), F.min("l_extendedprice").alias("low")), "mean", "low", digits=4)


@query("WITH c AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, coalesce(code, -1) AS segment, CASE WHEN c_nationkey = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS n_1, CASE WHEN c_nationkey = 2 THEN 1.0::DOUBLE ELSE 0.0 END AS n_2 FROM customer LEFT JOIN c USING (c_mktsegment)")
def encoded_customers(spark, sf):
    rows = table(spark, sf, "customer")
    out = P.OrdinalEncoder("c_mktsegment").fit(rows).transform(rows)
    out = P.dummies(out.withColumnRenamed("c_nationkey", "n"), "n", [0, 1, 2])
    return out.select("c_custkey", F.col("c_mktsegment").cast("long").alias("segment"), "n_1", "n_2")


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem) SELECT CASE WHEN l_extendedprice <= q[1] THEN 0 WHEN l_extendedprice <= q[2] THEN 1 WHEN l_extendedprice <= q[3] THEN 2 ELSE 3 END AS bin, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'low' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'middle' WHEN l_quantity > 30 AND l_quantity <= 50 THEN 'high' END AS size, count(*) AS n FROM lineitem, q GROUP BY 1, 2")
def price_bins(spark, sf):
    rows = P.qcut(table(spark, sf, "lineitem"), "l_extendedprice", 4, "bin")
    size = C.cut(F.col("l_quantity"), [0, 10, 30, 50], ["low", "middle", "high"])
    return rows.groupBy("bin", size.alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, date_diff('day', TIMESTAMP '1992-01-01', date_trunc('day', o_orderdate)) AS days, ((date_diff('day', TIMESTAMP '1992-01-01', date_trunc('day', o_orderdate)) % 28) + 28) % 28 AS cycle, round(o_totalprice / nullif(o_custkey % 4, 0), 4) AS ratio FROM orders")
def order_days(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("z", F.lit("1992-01-01"))
    days = C.days_between("d", "z", "yyyy-MM-dd").cast("long")
    return o.select("o_orderkey", days.alias("days"), C.wrap_cycle(days, 28).alias("cycle"), F.round(C.safe_div(F.col("o_totalprice"), F.col("o_custkey") % 4), 4).alias("ratio"))


# -- aggregates, joins, windows ---------------------------------------------------------------------------------------


@query("SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def described_prices(spark, sf):
    return rounded(A.describe(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]), "mean", "std", "q25", "q50", "q75", digits=4)


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(o_orderpriority) FROM orders), 6) AS share FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def priority_shares(spark, sf):
    return rounded(A.value_counts(table(spark, sf, "orders"), "o_orderpriority"), "share")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def flag_status_table(spark, sf):
    return A.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1")
def value_histogram(spark, sf):
    return A.histogram(table(spark, sf, "events"), "value", 20)


@query("SELECT count(*) FILTER (quality IS NULL) AS quality, count(*) FILTER (toxic IS NULL) AS toxic, count(*) FILTER (text IS NULL) AS text, count(*) FILTER (n_chars IS NULL) AS n_chars FROM documents LEFT JOIN labels USING (doc_id)")
def missing_labels(spark, sf):
    return A.missing_counts(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("quality", "toxic", "text", "n_chars"))


@query("SELECT event_type, round(avg(m), 6) AS mean, round(CASE WHEN count(m) > 1 THEN stddev_samp(m) / sqrt(count(m)) ELSE 0 END, 6) AS se, count(m) AS n FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def value_by_type(spark, sf):
    return rounded(A.mean_se_two_stage(table(spark, sf, "events"), ["event_type"], ["user_id"], ["value"]), "mean", "se")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rank, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS size_rank FROM part")
def part_ranks(spark, sf):
    perf = table(spark, sf, "part").withColumnsRenamed({"p_brand": "dataset", "p_retailprice": "rmse"})
    out = A.avg_rank(A.rank_models(perf, "p_partkey"), ["dataset"], "p_size", "size_rank")
    return out.select(F.col("dataset").alias("p_brand"), "p_partkey", F.col("rank").cast("long").alias("rank"), "size_rank")


@query("WITH s AS (SELECT c_nationkey AS s_nationkey, c_acctbal AS lo, o.q AS hi FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS q FROM orders GROUP BY 1) o ON o_custkey = c_custkey), b AS (SELECT s_nationkey, lo, max(hi) AS hi FROM s GROUP BY 1, 2), w AS (SELECT *, max(hi) OVER (PARTITION BY s_nationkey ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b) SELECT s_nationkey, round(lo, 2) AS lo, round(hi, 2) AS hi FROM w WHERE m IS NULL OR hi > m")
def customer_frontier(spark, sf):
    sums = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("hi"))
    rows = table(spark, sf, "customer").join(sums, "c_custkey").select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("lo"), "hi")
    return rounded(A.pareto(rows, "lo", "hi", ["s_nationkey"]), "lo", "hi", digits=2)


@query("WITH r AS (SELECT c_acctbal AS lo, c_custkey % 1000 AS hi FROM customer WHERE c_mktsegment = 'BUILDING') SELECT c_custkey FROM customer c WHERE c_mktsegment = 'AUTOMOBILE' AND NOT EXISTS (SELECT 1 FROM r WHERE r.lo <= c.c_acctbal AND r.hi >= c.c_custkey % 1000 AND (r.lo < c.c_acctbal OR r.hi > c.c_custkey % 1000))")
def undominated_customers(spark, sf):
    rows = table(spark, sf, "customer").withColumn("hi", F.col("c_custkey") % 1000)
    return A.non_dominated(rows.filter("c_mktsegment = 'AUTOMOBILE'"), rows.filter("c_mktsegment = 'BUILDING'"), "c_acctbal", "hi").select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_orders(spark, sf):
    return A.dedup(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END AS v FROM customer UNION ALL SELECT -s_suppkey, s_acctbal FROM supplier")
def upserted_balances(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = old.filter("k % 3 = 0").withColumn("v", -F.col("v")).unionByName(table(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("k"), F.col("s_acctbal").alias("v")))
    return S.upsert(old, new, ["k"])


@query("SELECT r.r_name AS model, m.c_mktsegment AS dataset FROM region r CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) m WHERE NOT EXISTS (SELECT 1 FROM customer c JOIN nation n ON n_nationkey = c_nationkey WHERE n_regionkey = r_regionkey AND c.c_mktsegment = m.c_mktsegment AND c_acctbal > 9900)")
def pending_segments(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    done = c.filter("c_acctbal > 9900").select(F.col("r_name").alias("model"), F.col("c_mktsegment").alias("dataset"))
    every = B.grid(table(spark, sf, "region").select(F.col("r_name").alias("model")), table(spark, sf, "customer").select(F.col("c_mktsegment").alias("dataset")).distinct())
    return S.pending_pairs(every, done)


PERF = "SELECT o_orderpriority AS dataset, l_returnflag AS model, sqrt(avg(power(l_extendedprice - 1500 * l_quantity, 2))) AS rmse FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"


def performance(spark, sf) -> DataFrame:
    """Errors of a fixed equation by priority (dataset) and return flag (model)."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select(F.col("o_orderpriority").alias("dataset"), F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("pred"))
    return A.rmse(rows, ["dataset", "model"])


@query(f"WITH p AS ({PERF}), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY rmse, model) AS rank FROM p) SELECT model, round(CASE WHEN count(rmse) = (SELECT count(DISTINCT dataset) FROM p) THEN avg(rank) END, 6) AS mean_rank FROM r GROUP BY 1")
def board_mean_rank(spark, sf):
    return rounded(B.mean_rank(performance(spark, sf)).select("model", "mean_rank"), "mean_rank")


@query(
    f"WITH p AS ({PERF}), r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY rmse) + (count(*) OVER (PARTITION BY dataset, rmse) - 1) / 2 AS rank FROM p), k AS (SELECT model AS model_id, avg(rank) AS mean_rank FROM r GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT dataset) FROM p)),"
    " f AS (SELECT l_returnflag AS model_id, l_quantity > 25 AS passed, CASE WHEN l_linestatus = 'F' THEN 'filled' ELSE 'open' END AS category FROM lineitem)"
    " SELECT model_id, round(mean_rank, 6) AS mean_rank, round((SELECT avg(passed::INT) FROM f WHERE f.model_id = k.model_id), 6) AS score, round((SELECT avg(passed::INT) FROM f WHERE f.model_id = k.model_id AND category = 'filled'), 6) AS filled, round((SELECT avg(passed::INT) FROM f WHERE f.model_id = k.model_id AND category = 'open'), 6) AS open FROM k"
)
def board_leaderboard(spark, sf):
    return leaderboard_of(performance(spark, sf), spark, sf)


def leaderboard_of(perf, spark, sf) -> DataFrame:
    facts = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model_id"), F.col("l_linestatus").alias("test"), (F.col("l_quantity") > 25).alias("passed"))
    tests = facts.select("test").distinct().withColumn("category", F.when(F.col("test") == "F", "filled").otherwise("open"))
    board = B.leaderboard(perf.withColumnRenamed("model", "model_id"), facts, tests, ["filled", "open"])
    return rounded(board, "mean_rank", "score", "filled", "open")


@query(ORACLES["board_mean_rank"])
def board_mean_rank_complete(spark, sf):
    return rounded(B.mean_rank(performance(spark, sf)).select("model", "mean_rank"), "mean_rank")


@query(ORACLES["board_leaderboard"])
def board_leaderboard_complete(spark, sf):
    return leaderboard_of(performance(spark, sf), spark, sf)


@query(r"SELECT conv_id, turn, try_cast(nullif(regexp_extract(text, '[-+]?[0-9]*[.]?[0-9]+(?:[eE][-+]?[0-9]+)?', 0), '') AS DOUBLE) AS got, coalesce(abs(try_cast(nullif(regexp_extract(text, '[-+]?[0-9]*[.]?[0-9]+(?:[eE][-+]?[0-9]+)?', 0), '') AS DOUBLE) - turn) <= greatest(abs(turn) * 0.25, 1.5), FALSE) AS passed FROM conversations")
def graded_turns(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("response"), F.col("turn").cast("double").alias("truth"))
    return B.grade(rows).select("conv_id", "turn", "got", "passed")


# -- models -----------------------------------------------------------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, round({READABLE.sql()}, 4) AS pred FROM lineitem")
def model_scores(spark, sf):
    return rounded(READABLE.transform(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "pred"), "pred", digits=4)


@query()
def model_price_terms(spark, sf):
    """A lasso over quantity, discount and tax with hinges, its alpha by five folds of one moment job, and its held-out error."""
    rows = P.drop_missing(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount", "l_tax"])
    rows = rows.withColumn("fold", F.expr("cast((l_orderkey * 7 + l_linenumber) % 5 as int)"))
    cols = {c: F.col(c) for c in ("l_quantity", "l_discount", "l_tax")}
    folds = gram(rows.filter(f"not ({HELD_OUT})"), cols, F.col("l_extendedprice"), ["fold"])
    fit, _ = L.lasso_cv(folds)
    model = linear_model(fit)
    error = A.rmse(model.transform(rows.filter(HELD_OUT)).withColumnRenamed("l_extendedprice", "label"), [])
    return model.frame(spark).crossJoin(F.broadcast(error))  # one row


@query("SELECT 'l_quantity' AS a, round(regr_slope(l_extendedprice, l_quantity), 4) AS coef, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(sqrt(1 - regr_r2(l_extendedprice, l_quantity)), 6) AS unexplained FROM lineitem")
def least_squares(spark, sf):
    m = gram(table(spark, sf, "lineitem"), {"l_quantity": F.col("l_quantity")}, F.col("l_extendedprice"))[()]
    e = L.ols(m)
    share = (m.sse(e.coef, e.intercept) / m.centered()[3]) ** 0.5
    return spark.createDataFrame([("l_quantity", round(float(e.coef[0]), 4), round(e.intercept, 3), round(share, 6))], "a string, coef double, intercept double, unexplained double")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS coef, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1")
def fits_by_flag(spark, sf):
    fits = gram(table(spark, sf, "lineitem"), {"l_quantity": F.col("l_quantity")}, F.col("l_extendedprice"), ["l_returnflag"])
    rows = [(k[0], round(float(e.coef[0]), 4), round(e.intercept, 3)) for k, m in fits.items() for e in [L.ols(m)]]
    return spark.createDataFrame(rows, "l_returnflag string, coef double, intercept double")


# -- tests ------------------------------------------------------------------------------------------------------------


@query(
    "WITH g AS (SELECT l_returnflag AS f, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM g WHERE f = 'A'), r AS (SELECT * FROM g WHERE f = 'R'), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS m FROM g)"
    " SELECT 'student' AS test, round((a.m - r.m) / sqrt(((a.n - 1) * a.v + (r.n - 1) * r.v) / (a.n + r.n - 2) * (1 / a.n + 1 / r.n)), 6) AS statistic, round(a.n + r.n - 2, 4) AS df FROM a, r"
    " UNION ALL SELECT 'welch', round((a.m - r.m) / sqrt(a.v / a.n + r.v / r.n), 6), round(power(a.v / a.n + r.v / r.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(r.v / r.n, 2) / (r.n - 1)), 4) FROM a, r"
    " UNION ALL SELECT 'anova', round((SELECT sum(g.n * power(g.m - t.m, 2)) FROM g) / (t.k - 1) / ((SELECT sum((g.n - 1) * g.v) FROM g) / (t.n - t.k)), 6), round(t.n - t.k, 4) FROM t"
    " UNION ALL SELECT 'cohen', round((a.m - r.m) / sqrt((a.v + r.v) / 2), 6), NULL FROM a, r"
    " UNION ALL SELECT 'pearson', round(corr(l_quantity, l_discount), 6), round(count(*) - 2, 4) FROM lineitem"
    " UNION ALL SELECT 'spearman', round(corr(x, y), 6), round(count(*) - 2, 4) FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS y FROM lineitem)"
    " UNION ALL SELECT 'mann_whitney', round(sum(rk) FILTER (f = 'A') - count(*) FILTER (f = 'A') * (count(*) FILTER (f = 'A') + 1) / 2, 6), round(count(*), 4) FROM (SELECT l_returnflag AS f, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rk FROM lineitem WHERE l_returnflag IN ('A', 'R'))"
    " UNION ALL SELECT 'chi2', round(sum(power(c - e, 2) / e), 6), round((SELECT (count(DISTINCT o_orderpriority) - 1) * (count(DISTINCT o_orderstatus) - 1) FROM orders), 4) FROM (SELECT count(o_orderkey) AS c, p.n * s.n / (SELECT count(*) FROM orders) AS e FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) p CROSS JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) s LEFT JOIN orders o ON o.o_orderpriority = p.o_orderpriority AND o.o_orderstatus = s.o_orderstatus GROUP BY p.o_orderpriority, s.o_orderstatus, p.n, s.n)"
)
def price_tests(spark, sf):
    rows, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    args = ("l_extendedprice", "l_returnflag", "A", "R")
    groups = H.group_moments(rows, *args[:2])
    found = {"student": H.ttest_ind(None, *args, moments=groups), "welch": H.ttest_ind(None, *args, equal_var=False, moments=groups), "anova": H.anova_oneway(None, *args[:2], moments=groups), "pearson": H.pearson(rows, "l_quantity", "l_discount"), "spearman": H.spearman(rows, "l_quantity", "l_discount"), "mann_whitney": H.mann_whitney(rows, "l_quantity", "l_returnflag", "A", "R"), "chi2": H.chi2_contingency(orders, "o_orderpriority", "o_orderstatus")}
    out = [(k, round(float(t.statistic), 6), round(float(t.df), 4)) for k, t in found.items()] + [("cohen", round(H.cohens_d(None, *args, moments=groups), 6), None)]
    return spark.createDataFrame(out, "test string, statistic double, df double")


@query()
def price_inference(spark, sf):
    """Least squares of line prices with plain, HC3 and supplier-clustered errors."""
    rows = table(spark, sf, "lineitem")
    xs = {c: F.col(c) for c in ("l_quantity", "l_discount", "l_tax")}
    out = []
    for cov in ("plain", "HC3", "cluster"):
        terms, r2, f = H.ols_inference(rows, "l_extendedprice", xs, cov, "l_suppkey")
        out += [(cov, *map(lambda v: v if isinstance(v, str) else float(v), t), float(r2), float(f)) for t in terms]
    return spark.createDataFrame(out, "cov string, term string, coef double, se double, t double, p double, low double, high double, r2 double, f double")


def effects(spark, found) -> DataFrame:
    return spark.createDataFrame([(e.name, e.coef, e.se, e.ratio) for e in found], "name string, coef double, se double, ratio double")


BY_DISCOUNT = "SELECT count(*) FILTER (l_discount > 0.05)::DOUBLE AS n1, count(*) FILTER (l_discount <= 0.05)::DOUBLE AS n0, count(*) FILTER (l_discount > 0.05 AND l_quantity > 25)::DOUBLE AS a1, count(*) FILTER (l_discount <= 0.05 AND l_quantity > 25)::DOUBLE AS a0, CAST(sum(l_quantity) FILTER (l_discount > 0.05) AS DOUBLE) AS s1, CAST(sum(l_quantity) FILTER (l_discount <= 0.05) AS DOUBLE) AS s0 FROM lineitem"


@query(f"WITH t AS ({BY_DISCOUNT}) SELECT 'intercept' AS name, round(ln(a0 / (n0 - a0)), 4) AS coef, round(sqrt(1 / a0 + 1 / (n0 - a0)), 4) AS se, round(a0 / (n0 - a0), 4) AS ratio FROM t UNION ALL SELECT 'high', round(ln(a1 * (n0 - a0) / (n1 - a1) / a0), 4), round(sqrt(1 / a0 + 1 / (n0 - a0) + 1 / a1 + 1 / (n1 - a1)), 4), round(a1 * (n0 - a0) / (n1 - a1) / a0, 4) FROM t")
def logistic_effects(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rounded(effects(spark, M.glm(rows, (F.col("l_quantity") > 25).cast("int"), {"high": (F.col("l_discount") > 0.05).cast("int")})), "coef", "se", "ratio", digits=4)


@query(f"WITH t AS ({BY_DISCOUNT}) SELECT 'intercept' AS name, round(ln(s0 / n0), 4) AS coef, round(sqrt(1 / s0), 4) AS se, round(s0 / n0, 4) AS ratio FROM t UNION ALL SELECT 'high', round(ln(s1 / n1 / (s0 / n0)), 4), round(sqrt(1 / s0 + 1 / s1), 4), round(s1 / n1 / (s0 / n0), 4) FROM t")
def poisson_effects(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rounded(effects(spark, M.glm(rows, F.col("l_quantity"), {"high": (F.col("l_discount") > 0.05).cast("int")}, "poisson")), "coef", "se", "ratio", digits=4)


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) SELECT round(corr(a, b), 8) AS rho, count(*) AS n FROM r")
def rank_correlation(spark, sf):
    found = H.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return spark.createDataFrame([(round(found.statistic, 8), int(found.df) + 2)], "rho double, n long")


@query("SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 40 THEN 2 ELSE 3 END AS quantity_bin, CASE WHEN l_discount <= 0.02 THEN 0 WHEN l_discount <= 0.06 THEN 1 ELSE 2 END AS discount_bin, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY ALL")
def bins_meeting(spark, sf):
    b = binned(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], F.col("l_extendedprice"), [[10.0, 20.0, 40.0], [0.02, 0.06]])[0]
    meet = b.meet[b.cells[0], b.cells[1]]
    return spark.createDataFrame([(i, j, int(meet[i, j])) for i in range(4) for j in range(3) if meet[i, j]], "quantity_bin int, discount_bin int, n long")


@query("SELECT l_linenumber, round(avg(l_extendedprice), 4) AS pred, count(*) AS n FROM lineitem GROUP BY 1")
def backfitted_lines(spark, sf):
    rows = table(spark, sf, "lineitem")
    model = G.bin_gam(rows, ["l_linenumber"], F.col("l_extendedprice"), bins=128)
    return rounded(model.transform(rows).groupBy("l_linenumber").agg(F.max("pred").alias("pred"), F.count(F.lit(1)).alias("n")), "pred", digits=4)


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def held_out_error(spark, sf, fit) -> DataFrame:
    """Test error of what ``fit`` learns on the other rows, by SQL's own split."""
    rows = table(spark, sf, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in [*FEATURES, "l_extendedprice", "l_orderkey"]), F.expr(HELD_OUT).alias("test"))
    model = fit(rows.filter("not test"), F.col("l_extendedprice"))
    return rounded(G.error_of(model, rows.filter("test"), F.col("l_extendedprice")), "rmse", "r2", digits=4)


@query()
def stump_gam_error(spark, sf):
    return held_out_error(spark, sf, lambda rows, y: G.stump_gam(rows, FEATURES, y, F.col("l_orderkey") % 7 == 0))


@query()
def hinge_lasso_error(spark, sf):
    return held_out_error(spark, sf, lambda rows, y: G.hinge_lasso(rows, FEATURES, y, F.col("l_orderkey") % 3))


@query()
def symbolic_error(spark, sf):
    return held_out_error(spark, sf, lambda rows, y: G.symbolic(rows, FEATURES, y, F.col("l_orderkey") % 7 == 0))


@query("SELECT l_linenumber, round(avg(l_extendedprice), 4) AS pred, count(*) AS n FROM lineitem GROUP BY 1")
def tree_lines(spark, sf):
    rows = table(spark, sf, "lineitem")
    tree = R.fit_tree(rows, ["l_linenumber"], F.col("l_extendedprice"), max_depth=7)
    return rounded(tree.transform(rows).groupBy("l_linenumber").agg(F.max("pred").alias("pred"), F.count(F.lit(1)).alias("n")), "pred", digits=4)


@query()
def tree_rules(spark, sf):
    rows = table(spark, sf, "lineitem")
    tree = R.shrink(R.fit_tree(rows, FEATURES, F.col("l_extendedprice"), max_depth=4, max_leaves=8), 10.0)
    return spark.createDataFrame([(i, r.text(), float(r.value), r.n) for i, r in enumerate(tree.rules())], "place int, rule string, value double, n long")


@query()
def corrected_error(spark, sf):
    def fit(rows, y):
        m = gram(rows, {c: F.col(c) for c in FEATURES}, y)[()]
        return E.with_corrector(linear_model(L.ols(m)), rows, FEATURES, y)

    rows = table(spark, sf, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in [*FEATURES, "l_extendedprice"]), F.expr(HELD_OUT).alias("test"))
    scored = fit(rows.filter("not test"), F.col("l_extendedprice")).transform(rows.filter("test"))
    return rounded(scored.agg(F.sqrt(F.avg(F.pow(F.col("l_extendedprice") - F.col("pred"), 2))).alias("rmse")), "rmse", digits=4)
