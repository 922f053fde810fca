"""Removal of repeated strings equals brute force over all windows, whatever the buckets and scan borders."""

import collections
import hashlib

import numpy as np
import pytest

from plainfit.llm import queries, suffixes

FIELDS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SF = "/root/testdata/sf0.001"


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows, sorted."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(x[i : i + length] for _, x in raw for i in range(len(x) - length + 1))
    out = []
    for key, x in raw:
        covered = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans = sum(1 for s in bytes(covered).split(b"\0") if s)
        out.append((key, len(x), sum(covered), spans, hashlib.sha256(bytes(b for b, c in zip(x, covered, strict=True) if not c)).hexdigest()))
    return sorted(out, key=repr)


def mine(spark, rows, length):
    docs = spark.createDataFrame([(i, t, 0, b"x") for i, t in rows], "doc_id long, text string, block int, start binary")
    return sorted(map(tuple, suffixes.remove_repeats(docs, suffixes.kept, FIELDS, length).collect()), key=repr)


def texts():
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 4, n)) for n in rng.integers(1, 9, 40)]
    passage = [" ".join(rng.choice(words, 40)) for _ in range(4)]
    rows = [(i, " ".join([*rng.choice(words, 30), passage[i % 4], *rng.choice(words, 20), passage[i % 3]])) for i in range(24)]
    rows += [(30, None), (31, ""), (None, rows[3][1]), (3, rows[3][1]), (32, "a" * 700), (33, "ab" * 300), (34, "é" * 90), (35, "short")]
    # Copies of one text with a letter changed here and there.
    base = " ".join(rng.choice(words, 300))
    rows += [(40 + k, base[: 97 * k] + "Z" + base[97 * k + 1 :]) for k in range(12)]
    return rows


@pytest.mark.parametrize("length", [1, 7, 64, 100, 130])
def test_equals_all_windows(spark, length):
    assert mine(spark, texts(), length) == brute(texts(), length)


def test_boundaries_are_compared_whatever_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 8)
    rows = [*texts(), *((100 + i, "one line that all share " * 9) for i in range(60))]
    assert mine(spark, rows, 100) == brute(rows, 100)


def test_empty_table_and_no_repeats(spark):
    assert mine(spark, [], 50) == []
    assert mine(spark, [(1, "alone")], 50) == brute([(1, "alone")], 50)


def test_every_window_is_in_one_suffix_whatever_the_span(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = np.array([0, 300, 39, 40, 1000, 5])
    x = rng.integers(97, 100, sizes.sum()).astype(np.uint8)
    for span in (1 << 21, 64, 17):
        monkeypatch.setattr(suffixes, "SPAN", span)
        starts = np.concatenate([np.concatenate([np.arange(p - m, p - l + 1) for p, m, l in zip(place, most, least, strict=True)]) for *_, place, most, least in suffixes.anchors(x, sizes, 40)])
        ends = np.cumsum(sizes)
        want = np.concatenate([np.arange(e - n, e - 39) for e, n in zip(ends, sizes, strict=True) if n >= 40])
        assert sorted(starts.tolist()) == want.tolist()


def test_multikey_sort_goes_by_one_token_after_the_other():
    rng = np.random.default_rng(2)
    a, b, c = (rng.integers(0, 5, 500) for _ in range(3))
    assert np.array_equal(suffixes.multikey_sort([a, b, c]), np.lexsort((c, b, a)))


def test_registered_query_equals_all_windows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries.queries()["op13_repeats"](spark, SF).collect()), key=repr)
    assert got == brute([tuple(r) for r in docs], 400)
    assert sum(r[2] for r in got) > 0
