"""Importance resampling equals brute force and its SQL, for any dictionary and any length of runs."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from plainfit.llm import importance, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", " ", "Ünïcode İS Σ 日本語 mixed123 words", "a-b_c.d  e\x00f\ng", "same same same", "x" * 5000, "-" * 40, "é" * 40 + " short", "\U0001f389 🎉🎉"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def run_hashes(ws, most):
    return [zlib.crc32(" ".join(ws[i : i + k]).encode()) for k in range(1, most + 1) for i in range(len(ws) - k + 1)]


@pytest.mark.parametrize("most", [1, 2, 4])
def test_scan_and_composition_equal_hashes_of_the_text(most):
    known = sorted({w.encode() for t in ODD for w in words(t)})
    for dictionary in ([], known[::2], [w for w in known if len(w) <= importance.LONGEST]):
        scanner = importance.Dictionary(dictionary)
        for text in ODD:
            assert importance.features(*scanner.scan(text), most).tolist() == run_hashes(words(text), most)


def test_composition_of_long_parts():
    rng = np.random.default_rng(0)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 70_000, (20, 2))]
    left, right = (np.array([zlib.crc32(p[k]) for p in parts], dtype=np.uint32) for k in (0, 1))
    assert importance.composed(left, right, np.array([len(b) for _, b in parts])).tolist() == [zlib.crc32(a + b) for a, b in parts]


def brute(docs, target, most, buckets, percent, least, seed):
    own = {i: [h % buckets for h in run_hashes(words(t), most)] for i, t in enumerate(t for _, t in docs)}
    s, t = np.zeros(buckets), np.zeros(buckets)
    for b in own.values():
        np.add.at(s, b, 1)
    for x in target:
        np.add.at(t, [h % buckets for h in run_hashes(words(x), most)], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for i, (key, text) in enumerate(docs):
        weight = sum(gain[b] for b in own[i]) // len(own[i]) if own[i] else 0
        h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(own[i]), weight, None if key is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    eligible = sorted((r for r in rows if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(eligible[: len(eligible) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("most", [1, 3])
def test_odd_tables(spark, most):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([w for t in ODD for w in words(t) if len(w) < 99] + ["foo", "bar"], 30)) for _ in range(60)]
    docs = [*enumerate(base), *((100 + i, t) for i, t in enumerate(ODD)), (7, base[7]), (7, "foo " * 25), (None, base[0]), (200, None)]
    target = [base[3], None, "foo bar foo", ""]
    df = spark.createDataFrame([(i, t, 5, 1.0) for i, t in docs], "doc_id long, text string, rank int, weight double")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(map(tuple, importance.resample(df, goal, 20, 9, most, 500, 5).collect()), key=repr)
    assert got == brute(docs, target, most, 500, 20, 5, 9)
    assert importance.resample(df.limit(0), goal, 20).collect() == []
    assert importance.resample(df.limit(3), goal.limit(0), 20).count() == 3


def test_registered_query_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({queries.oracle_sql()['op11_importance']})").fetchall()
    got = queries.queries()["op11_importance"](spark, SF)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect())) == sorted(want)
