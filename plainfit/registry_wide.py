"""Registered queries of the smaller operators: sinks and sources, selection, rounding, calibration, boards and splits, with SQL of their own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .functions.columns import fourier
from .operators import additive as G
from .operators import aggregate as A
from .operators import board as B
from .operators import curated
from .operators import linear as L
from .operators import prep as P
from .operators import teacher as E
from .operators import tree as R
from .plans.gram import gram
from .registry import FEATURES, HELD_OUT, QUERIES, READABLE, query, rounded, table
from .registry_closed import ORACLES
from .registry_more import KEY, _register
from .sources import tables as S
from .sources.scratch import shared_path

__all__ = ["ORACLES", "QUERIES"]

X, Y = "l_quantity", "l_extendedprice"

# -- sources and sinks ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_mktsegment IS NOT NULL")
def facts_through_csv(spark, sf):
    """Customers written as a fact table in text, and read again with a schema and a label."""
    path, columns = shared_path(spark, "facts"), ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    S.write_facts(table(spark, sf, "customer"), path, columns)
    back = S.read_table(spark, path, "c_mktsegment", "csv", "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string")
    return rounded(back.drop("label"), "c_acctbal", digits=2)


@query("SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, 'here' AS experiment FROM nation")
def optional_nations(spark, sf):
    """A source that is there and one that isn't."""
    return S.read_optional(spark, {"here": f"{sf}/nation.parquet", "missing": f"{sf}/no such table.parquet"}, "n_name string, n_regionkey long")


@query(
    "WITH f AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS k FROM nation JOIN region ON r_regionkey = n_regionkey)"
    " SELECT 'Which nation of ' || r_name || '?' AS question, 'Nations of ' || r_name AS description, string_agg(n_name || ': the ' || k || '.', '; ' ORDER BY k) AS fields FROM f WHERE k <= 3 GROUP BY r_name"
)
def task_documents(spark, sf):
    """One document for each region, written as JSON and read as tasks."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = nations.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names"))  # a region's nations
    fields = F.transform("names", lambda n, i: F.struct(n.alias("column"), F.struct(F.concat(F.lit("the "), (i + 1).cast("string"), F.lit(".")).alias("description")).alias("properties")))
    docs = names.select(F.array(F.concat(F.lit("Which nation of "), "r_name", F.lit("?"))).alias("research_questions"), F.struct(F.concat(F.lit("Nations of "), "r_name").alias("dataset_description"), fields.alias("fields")).alias("data_desc"))
    path = shared_path(spark, "tasks")
    docs.withColumn("key", F.col("data_desc.dataset_description")).write.partitionBy("key").json(path)
    return S.read_task_docs(spark, path, 3)


@query("SELECT column_name AS name, column_type NOT LIKE 'VARCHAR%' AND column_type NOT LIKE 'DATE%' AND column_type NOT LIKE 'TIMESTAMP%' AND column_type <> 'BOOLEAN' AS is_number FROM (DESCRIBE lineitem)")
def kinds_of_columns(spark, sf):
    numbers, others = P.split_columns(table(spark, sf, "lineitem"))
    return spark.createDataFrame([(c, c in numbers) for c in [*numbers, *others]], "name string, is_number boolean")


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS quantity FROM lineitem WHERE l_discount <= 0.05 AND l_tax > 0.01 GROUP BY 1")
def complete_lines(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"d": F.when(F.col("l_discount") <= 0.05, F.col("l_discount")), "t": F.when(F.col("l_tax") > 0.01, F.col("l_tax"))})
    return rounded(P.drop_missing(rows, ["d", "t"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("quantity")), "quantity")


# -- splits -----------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS keys, count(DISTINCT l_orderkey) AS split_keys, count(DISTINCT l_orderkey) AS fold_keys, 5 AS folds, least(1000, count(*)) AS capped, count(*) AS held_and_left, 0 AS in_both FROM lineitem")
def dealt_rows(spark, sf):
    """What holds of splits by key: a key is on one side and in one fold, samples have their size, a hold-out and the rest are all rows."""
    rows, key = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X), ["l_orderkey"]
    dealt = P.with_fold(P.split(rows, key), key, 5)
    row = dealt.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("keys"), F.count_distinct("l_orderkey", "split").alias("split_keys"), F.count_distinct("l_orderkey", "fold").alias("fold_keys"), F.count_distinct("fold").alias("folds"))
    train, held = P.holdout(rows, key)
    both = train.select(*key).distinct().join(held.select(*key).distinct(), key).count()
    more = (P.cap(rows, ["l_orderkey", "l_linenumber"], 1000).count(), train.count() + held.count(), both)
    return row.withColumns({"capped": F.lit(more[0]).cast("long"), "held_and_left": F.lit(more[1]).cast("long"), "in_both": F.lit(more[2])})


# -- selection, rounding, evidence ------------------------------------------------------------------------------------

MIXED = f"({X} * 100 + l_discount * 20000 + l_tax * 5000 + {Y} / 100)"


def mixed(rows):
    cols = {"q": F.col(X), "d": F.col("l_discount"), "t": F.col("l_tax"), "q2": F.col(X) * 2.0 + 1.0}
    return gram(rows, cols, F.expr(MIXED))[()]


@query(
    f"WITH c AS (SELECT corr({MIXED}, {X}) AS yq, corr({MIXED}, l_discount) AS yd, corr({MIXED}, l_tax) AS yt, corr({X}, l_discount) AS qd, corr({X}, l_tax) AS qt, corr(l_discount, l_tax) AS dt FROM lineitem),"
    " s AS (SELECT unnest(['q', 'd', 't']) AS v, unnest([yq, yd, yt]) AS r FROM c), p AS (SELECT unnest(['q', 'q', 'd', 'd', 't', 't']) AS a, unnest(['d', 't', 'q', 't', 'q', 'd']) AS b, unnest([qd, qt, qd, dt, qt, dt]) AS r FROM c),"
    " f AS (SELECT arg_max(v, abs(r)) AS v, arg_max(r, abs(r)) AS r FROM s), g AS (SELECT s.v, abs(s.r - f.r * p.r) AS rest, abs(s.r - f.r * p.r) / sqrt(1 - p.r * p.r) AS part FROM s, f JOIN p ON p.a = f.v WHERE p.b = s.v)"
    " SELECT 'prescreen' AS kind, 1 AS place, 'q' AS name UNION ALL SELECT 'prescreen', 2, 'd' UNION ALL SELECT 'prescreen', 3, 't'"
    " UNION ALL SELECT kind, 1, v FROM f, unnest(['forward', 'pursuit']) k(kind) UNION ALL SELECT 'forward', 2, arg_max(v, part) FROM g UNION ALL SELECT 'pursuit', 2, arg_max(v, rest) FROM g"
    " UNION ALL SELECT 'correlation', CAST(row_number() OVER (ORDER BY abs(r) DESC) AS INTEGER), v FROM s"
)
def chosen_columns(spark, sf):
    """A copied column goes; greedy selection, matching pursuit and correlations on the others."""
    m = mixed(table(spark, sf, "lineitem"))
    three = m.only(L.prescreen(m))
    ranked = [n for n, _ in L.top_correlations(three)]
    found = {"prescreen": three.names, "forward": [three.names[i] for i in L.forward(three, 2)], "pursuit": [three.names[i] for i in L.omp(three, 2)], "correlation": ranked}
    return spark.createDataFrame([(k, i + 1, n) for k, names in found.items() for i, n in enumerate(names)], "kind string, place int, name string")


SMALL = f"({X} * 0.0371 + l_tax * 20)"


@query(
    f"WITH r AS (SELECT {HELD_OUT} AS t, {X} AS x, {SMALL} AS y FROM lineitem), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r WHERE NOT t), e AS (SELECT sum(power(y - a - b * x, 2)) AS e FROM r, f WHERE t),"
    " d AS (SELECT k, sum(power(y - round(a, k) - round(b, k) * x, 2)) AS s FROM r, f, unnest([0, 1, 2, 3, 4]) t(k) WHERE r.t GROUP BY 1), k AS (SELECT min(k) AS k FROM d, e WHERE s <= e * 1.001)"
    " SELECT k AS digits, round(b, k) AS slope, round(a, k) AS intercept FROM f, k"
)
def rounded_fit(spark, sf):
    """The fewest decimals that cost next to nothing on the held-out rows."""
    parts = gram(table(spark, sf, "lineitem").withColumn("t", F.expr(HELD_OUT)), {X: F.col(X)}, F.expr(SMALL), ["t"])
    fit = L.round_coefs(L.ols(parts[(False,)]), parts[(True,)])
    digits = next(d for d in range(5) if round(float(fit.coef[0]), d) == float(fit.coef[0]) and round(fit.intercept, d) == fit.intercept)
    return spark.createDataFrame([(digits, float(fit.coef[0]), float(fit.intercept))], "digits int, slope double, intercept double")


@query(
    f"WITH m AS (SELECT count(*) AS n, regr_sxx({SMALL}, {X}) AS s, regr_sxy({SMALL}, {X}) AS c, regr_syy({SMALL}, {X}) AS yy FROM lineitem),"
    " z AS (SELECT list_reduce(list_prepend([n / yy, 1.0::DOUBLE], list_transform(range(60), lambda i: [0.0::DOUBLE, 0.0::DOUBLE])), lambda a, i:"
    " [(n - a[1] * s / (a[2] + a[1] * s)) / (yy - 2 * c / (s + a[2] / a[1]) * c + power(c / (s + a[2] / a[1]), 2) * s), (a[1] * s / (a[2] + a[1] * s)) / power(c / (s + a[2] / a[1]), 2)]) AS z, s, c FROM m)"
    " SELECT round(c / (s + z[2] / z[1]), 8) AS slope, round(z[1], 4) AS noise, round(z[2], 4) AS weight FROM z"
)
def bayesian_slope(spark, sf):
    """Ridge whose two precisions have the greatest evidence."""
    fit, noise, weight = L.bayesian_ridge(gram(table(spark, sf, "lineitem"), {X: F.col(X)}, F.expr(SMALL))[()])
    return spark.createDataFrame([(round(float(fit.coef[0]), 8), round(float(noise), 4), round(float(weight), 4))], "slope double, noise double, weight double")


@query("SELECT l_returnflag, count(*) >= 20000 AS large FROM lineitem GROUP BY 1")
def large_segments(spark, sf):
    found = gram(table(spark, sf, "lineitem"), {X: F.col(X)}, F.col(Y), ["l_returnflag"])
    return spark.createDataFrame([(k[0], bool(P.check_size(m, 20000))) for k, m in found.items()], "l_returnflag string, large boolean")


WAVES = 3


def waves_sql() -> str:
    """The same draws as the library's features, written out."""
    rng, out = np.random.default_rng(7), []
    for k in range(WAVES):
        w, b = rng.normal(0.0, 1.0, 2), rng.uniform(0, 2 * np.pi)
        out.append(f"round({(2 / WAVES) ** 0.5!r} * cos({float(b)!r} + {float(w[0])!r} * ({X} - 25.0) / 14.0 + {float(w[1])!r} * (l_discount - 0.05) / 0.03), 6) AS rff{k}")
    return ", ".join(out)


@query(f"SELECT l_orderkey, l_linenumber, {waves_sql()} FROM lineitem")
def wave_features(spark, sf):
    cols = fourier([X, "l_discount"], WAVES, 0.5, 7, {X: (25.0, 14.0), "l_discount": (0.05, 0.03)})
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in cols.items())), *cols)


# -- additive models, teachers, trees ---------------------------------------------------------------------------------


@query(
    f"WITH g AS (SELECT l_linenumber, count(*) AS c, sum({Y}) AS s FROM lineitem GROUP BY 1), t AS (SELECT sum(c) AS n, sum(s) / sum(c) AS m FROM g), r AS (SELECT l_linenumber, c, (s - c * m) / (c + 1000) AS u, c / (c + 1000.0) AS v FROM g, t),"
    " k AS (SELECT sum(c * u) / (any_value(n) - sum(c * v)) AS k FROM r, t), f AS (SELECT l_linenumber, c, u + v * k AS f FROM r, k), e AS (SELECT sum(c * f) / sum(c) AS e FROM f)"
    " SELECT l_linenumber, round(m + f - e, 4) AS pred FROM f, t, e"
)
def ridged_bins(spark, sf):
    """Ridge on the indicators of the line numbers."""
    rows = table(spark, sf, "lineitem")
    model = G.bin_ridge_gam(rows, ["l_linenumber"], F.col(Y), 128, 1000.0)
    return rounded(model.transform(rows).groupBy("l_linenumber").agg(F.max("pred").alias("pred")), "pred", digits=4)


@query(
    f"WITH p AS (SELECT {Y} AS y, {READABLE.sql()} AS a, 50000 + 100 * l_linenumber AS b FROM lineitem), e AS (SELECT 1 / avg(power(y - a, 2)) AS wa, 1 / avg(power(y - b, 2)) AS wb, regr_slope(y, a) AS slope, regr_intercept(y, a) AS intercept FROM p)"
    " SELECT round(slope, 8) AS slope, round(intercept, 4) AS intercept, round(wa / (wa + wb), 8) AS first, round(wb / (wa + wb), 8) AS second, round((SELECT avg(0.6 * (wa * a + wb * b) / (wa + wb) + 0.4 * y) FROM p), 4) AS target FROM e"
)
def calibrated_teachers(spark, sf):
    """A calibrated model, weights of two teachers by their errors, and the mean of the blended target."""
    rows = table(spark, sf, "lineitem")
    fit = E.calibrate(READABLE, rows, F.col(Y))
    said = READABLE.transform(rows, "a").withColumn("b", F.lit(50000.0) + 100 * F.col("l_linenumber"))
    weights = E.error_weights(said, ["a", "b"], F.col(Y))
    target = said.agg(F.avg(E.blended(F.col(Y), dict(zip("ab", weights, strict=True)), 0.6))).first()[0]
    return spark.createDataFrame([(round(fit.slope, 8), round(fit.intercept, 4), round(weights[0], 8), round(weights[1], 8), round(target, 4))], "slope double, intercept double, first double, second double, target double")


@query(
    "WITH g AS (SELECT l_linenumber AS b, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1), c AS (SELECT b, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM g WINDOW w AS (ORDER BY b)),"
    " k AS (SELECT arg_max(b, sl * sl / nl + (s - sl) * (s - sl) / (n - nl)) AS b FROM c WHERE nl < n)"
    " SELECT l_linenumber, round(any_value(CASE WHEN l_linenumber <= c.b THEN sl / nl ELSE (s - sl) / (n - nl) END), 6) AS value FROM lineitem, c JOIN k ON c.b = k.b GROUP BY 1"
)
def listed_rules(spark, sf):
    """A tree's rules as a decision list."""
    rows = table(spark, sf, "lineitem")
    rules = R.fit_tree(rows, ["l_linenumber"], F.col(X), max_depth=1).rules()
    return rounded(rows.withColumn("value", R.decision_list(rules, -1.0)).groupBy("l_linenumber").agg(F.max("value").alias("value")), "value")


# -- boards -----------------------------------------------------------------------------------------------------------


@query(
    f"WITH p AS (SELECT l_returnflag AS d, l_linestatus AS m, avg({Y}) AS e FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY e, m) AS r FROM p)"
    " SELECT m AS model_name, 'as it was' AS description, round(CASE WHEN count(DISTINCT d) = (SELECT count(DISTINCT d) FROM p) THEN avg(r) END, 6) AS mean_rank FROM r GROUP BY 1"
)
def refreshed_ranks(spark, sf):
    perf = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("model")).agg(F.avg(Y).alias("rmse"))
    overall = perf.select(F.col("model").alias("model_name"), F.lit("as it was").alias("description")).distinct().withColumn("mean_rank", F.lit(0.0))
    return rounded(B.refresh_ranks(overall, perf), "mean_rank")


DIMENSIONS = {"correctness": "l_quantity", "completeness": "l_discount * 100", "clarity": "l_tax * 100"}
JUDGED = ", ".join(f"avg({e}) AS {n}" for n, e in DIMENSIONS.items())


@query(
    f"WITH m AS (SELECT l_linestatus AS mode, l_orderkey % 7 AS run, l_linenumber % 3 AS judge, {JUDGED} FROM lineitem GROUP BY 1, 2, 3), d AS ("
    + " UNION ALL ".join(f"SELECT mode, '{n}' AS dimension, {e} AS v FROM m" for n, e in [*((n, n) for n in DIMENSIONS), ("overall", f"({' + '.join(DIMENSIONS)}) / 3")])
    + "), c AS (SELECT mode, dimension, printf('%.2f±%.2f', avg(v), stddev_samp(v) / sqrt(count(*))) AS cell FROM d GROUP BY 1, 2) SELECT dimension, max(cell) FILTER (mode = 'F') AS \"F\", max(cell) FILTER (mode = 'O') AS \"O\" FROM c GROUP BY 1"
)
def compared_modes(spark, sf):
    rows = table(spark, sf, "lineitem")
    scores = rows.select(F.col("l_linestatus").alias("mode"), F.col("l_returnflag").alias("dataset"), (F.col("l_orderkey") % 7).alias("run_id"), (F.col("l_linenumber") % 3).alias("judge_id"), *(F.expr(e).alias(n) for n, e in DIMENSIONS.items()))
    return B.compare_modes(scores, ["F", "O"])


@query(
    "WITH r AS (SELECT r_regionkey, replace(lower(r_name), ' ', '') AS commit FROM region), f AS (SELECT commit, commit || '_' || n_name || '.png' AS path, n_nationkey % 3 AS place FROM r JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 3 < 2)"
    " SELECT commit, (SELECT arg_min(path, (place, path)) FROM f WHERE f.commit = r.commit) AS artifact FROM r"
)
def attached_artifacts(spark, sf):
    """The first file in order of place and path for each commit."""
    name = F.replace(F.lower("r_name"), F.lit(" "), F.lit("")).alias("commit")
    base = table(spark, sf, "region").select("r_regionkey", name)
    files = base.join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey % 3 < 2")
    files = files.select(F.concat("commit", F.lit("_"), F.translate("n_name", " ", " "), F.lit(".png")).alias("path"), (F.col("n_nationkey") % 3).alias("place"))
    return B.attach_artifact(base, files, r"^(\w+?)_").select("commit", "artifact")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 101 AS INTEGER) END AS response, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS explanation, c_custkey % 3 = 0 AS parse_error FROM customer")
def parsed_conclusions(spark, sf):
    """Answers inside of prose, a third of them without any."""
    said = F.concat(F.lit("So I think {\"response\": "), (F.col("c_custkey") % 101).cast("string"), F.lit(", \"explanation\": \""), "c_mktsegment", F.lit("\"} is it."))
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, said).otherwise("no answer").alias("text"))
    return B.parse_conclusions(rows).select("c_custkey", "response", "explanation", "parse_error")


# -- named models -----------------------------------------------------------------------------------------------------


@query(
    f"WITH q AS (SELECT quantile_cont({X}, 0.01) AS lo, quantile_cont({X}, 0.99) AS hi FROM lineitem), x AS (SELECT least(greatest({X}, lo), hi) AS x, {SMALL} AS y FROM lineitem, q)"
    " SELECT round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(any_value(lo), 6) AS low, round(any_value(hi), 6) AS high FROM x, q"
)
def winsorized_sparse_line(spark, sf):
    """The named model on one column."""
    rows = table(spark, sf, "lineitem")
    model = curated.winsorized_sparse_ols(rows, [X], F.expr(SMALL), ["l_orderkey", "l_linenumber"])
    t = model.terms[0]
    return spark.createDataFrame([(round(t.coef, 8), round(float(model.intercept), 6), round(t.knot, 6), round(t.high, 6))], "slope double, intercept double, low double, high double")


@query(
    f"WITH g AS (SELECT l_linenumber AS b, count(*) AS n, sum({Y}) AS s FROM lineitem GROUP BY 1), c AS (SELECT b, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM g WINDOW w AS (ORDER BY b)),"
    " r AS (SELECT arg_max(b, sl * sl / nl + (s - sl) * (s - sl) / (n - nl)) AS b FROM c WHERE nl < n), h AS (SELECT g.b, n, s, g.b <= r.b AS side FROM g, r),"
    " d AS (SELECT b, side, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY side) AS n, sum(s) OVER (PARTITION BY side) AS s FROM h WINDOW w AS (PARTITION BY side ORDER BY b)),"
    " k AS (SELECT side, arg_max(b, sl * sl / nl + (s - sl) * (s - sl) / (n - nl)) AS b FROM d WHERE nl < n GROUP BY 1)"
    " SELECT h.b AS l_linenumber, round(sum(s) OVER (PARTITION BY h.side, h.b <= coalesce(k.b, 99)) / sum(n) OVER (PARTITION BY h.side, h.b <= coalesce(k.b, 99)), 4) AS pred FROM h LEFT JOIN k ON k.side = h.side"
)
def tiny_tree_lines(spark, sf):
    """The named tree of four leaves on the line numbers."""
    rows = table(spark, sf, "lineitem")
    tree = curated.tiny_tree(rows, ["l_linenumber"], F.col(Y))
    return rounded(tree.transform(rows).groupBy("l_linenumber").agg(F.max("pred").alias("pred")), "pred", digits=4)


for _name in ("dual_path_sparse_symbolic", "teacher_student_rule_spline", "distilled_tree_blend_atlas"):
    _register(f"{_name}_error", lambda rows, y, f=curated.MODELS[_name]: f(rows, FEATURES, y, KEY, trees=10))
