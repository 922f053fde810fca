"""Vector codes equal brute force in Python's integers and their SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from plainfit.llm import queries, vector_codes
from plainfit.llm.common import materialise

SF = "/root/testdata/sf0.001"


def brute(rows, n_parts, entries, rounds, scale):
    """{position in rows: (code, error)} and the digest of the codebooks, for (id, vector, label) rows."""
    kept = {i: [math.floor(float(x) * scale) for x in v] for i, (_, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    order = sorted((i for i in kept if kept[i] and len(kept[i]) % n_parts == 0), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, kept[i]))
    order = [i for i in order if len(kept[i]) == len(kept[order[0]])]
    width = len(kept[order[0]]) // n_parts
    part = lambda i, p: kept[i][p * width : p * width + width]
    books = [[part(i, p) for i in order[:entries]] for p in range(n_parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for i in order:
                members.setdefault(near(part(i, p), book)[1], []).append(part(i, p))
            for e, some in members.items():
                book[e] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    # Errors are held at the greatest long.
    best = {i: [near(part(i, p), books[p]) for p in range(n_parts)] for i in order}
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in b), min(sum(d for d, _ in b), vector_codes.TOP)) for i, b in best.items()}, digest


def mine(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, v int")
    coded, books = vector_codes.encode_vectors(df, "vec_id", "embedding", ["label"], **settings)
    coded = vector_codes.with_group_error(materialise(coded, "coded"), "label", "label_error")
    return sorted(map(tuple, coded.collect()), key=repr), vector_codes.books_digest(books)


def wanted(rows, n_parts, entries, rounds, scale):
    coded, digest = brute(rows, n_parts, entries, rounds, scale)
    total = {}
    for i, (_, error) in coded.items():
        total[rows[i][2]] = total.get(rows[i][2], 0) + error
    return sorted(((rows[i][0], rows[i][2], code, error, min(total[rows[i][2]], vector_codes.TOP)) for i, (code, error) in coded.items()), key=repr), digest


def random_rows(n, dim, levels, seed=0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.integers(-levels, levels, dim) / 8], int(rng.integers(0, 3)) or None) for i in rng.permutation(n)]


ODD = [(5000, None, 1), (5001, [None] + [0.5] * 7, 1), (5002, [float("nan")] * 8, 1), (5003, [float("inf")] * 8, 2), (5004, [], 2), (5005, [0.1] * 4, 2), (5006, [0.1] * 7, None), (None, [0.25] * 8, None), (3, [0.5] * 8, 7), (3, [0.5] * 8, 7)]


@pytest.mark.parametrize(("n", "levels", "entries"), [(700, 3, 16), (300, 100, 40), (20, 3, 64)])
def test_equals_python_integers(spark, n, levels, entries):
    rows = [*random_rows(n, 8, levels), *ODD]
    assert mine(spark, rows, n_parts=4, entries=entries, rounds=3, scale=1024) == wanted(rows, 4, entries, 3, 1024)


def test_huge_components_stay_exact(spark):
    rows = [(i, [x * 2.0**e for x, e in zip(v, (0, 20, 30, 40), strict=True)], label) for i, v, label in random_rows(60, 4, 50)]
    assert mine(spark, rows, n_parts=2, entries=8, rounds=2, scale=16) == wanted(rows, 2, 8, 2, 16)


def test_one_part_in_a_third_of_all_rows_and_empty_tables(spark):
    rows = random_rows(200, 8, 40)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, label) for i, v, label in rows]
    assert mine(spark, rows, n_parts=2, entries=16, rounds=2, scale=64) == wanted(rows, 2, 16, 2, 64)
    for none in ([], ODD[:5]):
        assert mine(spark, none)[0] == []


def test_nearest_is_the_least_of_all_distances():
    rng = np.random.default_rng(4)
    parts, _ = vector_codes.distinct(rng.integers(-2, 3, (2000, 5)))
    entries = rng.integers(-2, 3, (30, 5))
    best, error = vector_codes.nearest(parts, entries)
    all_ = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert np.array_equal(best, all_.argmin(axis=1)) and np.array_equal(error, all_.min(axis=1))


def test_registered_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    names = "vec_id, code, error, label_error, codebooks_sha256"
    want = con.sql(f"SELECT {names} FROM ({queries.oracle_sql()['op12_codes']})").fetchall()
    got = queries.queries()["op12_codes"](spark, SF)
    assert sorted(map(tuple, got.select(names.split(", ")).collect())) == sorted(want)
