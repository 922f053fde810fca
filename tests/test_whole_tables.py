"""Registered queries that take all rows; unseen categories and missing pairs are in small tables here."""

import duckdb

from plainfit import registry
from plainfit.operators import board as B
from plainfit.operators import prep as P

SF = "/root/testdata/sf0.001"


def test_all_lines_are_imputed(spark):
    got = registry.QUERIES["median_imputed_lines"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert got.filter("l_orderkey % 2 = 1 and price is not null").count() > 0


def test_encoder_learns_from_all_customers(spark, tmp_path):
    rows = [(3, "A", 1), (4, "ONLY HERE", 2), (5, "A", 1)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: r.segment for r in registry.QUERIES["encoded_customers"](spark, str(tmp_path)).collect()}
    assert got == {3: 0, 4: 1, 5: 0}


def test_an_unseen_category_is_minus_one(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "c string")
    got = P.OrdinalEncoder("c").fit(rows.filter("c = 'a'")).transform(rows)
    assert sorted(int(r.c) for r in got.collect()) == [-1, 0]


def test_boards_keep_every_pair(spark):
    pairs = registry.performance(spark, SF).count()
    want = duckdb.sql(f"SELECT count(DISTINCT (o_orderpriority, l_returnflag)) FROM '{SF}/lineitem.parquet' JOIN '{SF}/orders.parquet' ON o_orderkey = l_orderkey").fetchall()[0][0]
    assert pairs == want
    for name in ("board_mean_rank_complete", "board_leaderboard_complete"):
        rows = registry.QUERIES[name](spark, SF).filter("mean_rank is not null").collect()
        assert "A" in {r[0] for r in rows}


def test_a_missing_pair_gives_no_mean_rank(spark):
    perf = spark.createDataFrame([("d", "x", 1.0), ("d", "y", 2.0), ("e", "y", 1.0)], "dataset string, model string, rmse double")
    assert {r.model: r.mean_rank for r in B.mean_rank(perf).collect()} == {"x": None, "y": 1.5}
