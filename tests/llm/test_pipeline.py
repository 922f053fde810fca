"""Every stage of the pipeline against brute force on the smallest tables: fitted filters by hand, all pairs, the tokenizers library."""

import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plainfit.llm import pii, quality, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """name: (rows before, rows after), each as the rows of a table."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).collect()
        out[name] = (docs.collect(), after)
        if name != "packing":
            docs = spark.createDataFrame(after, docs.schema)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)


def test_filters_by_hand(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(frame(spark, before), labels, queries.grade(), 3)
    kept = set()
    for r in before:
        tokens = (r.text or "").split()
        score = sum(model.weights[b] for t in tokens for b in quality.features(t)) / max(len(tokens), 1)
        score += model.weights[quality.AGAIN] * (sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / len(tokens) if tokens else 0)
        if 1 / (1 + np.exp(model.thresholds[0] - score)) >= 0.5:
            kept.add(r)
    assert set(after) == kept and 0 < len(kept) < len(before)
    before, after = stages["toxicity"]
    model = toxicity.fit_toxicity(frame(spark, before), labels.filter(~queries.held_out()), F.col("toxic"))
    kept = set()
    for r in before:
        none = 1.0
        for s in re.split(r"[.!?\n]", (r.text or "").lower()):
            found = [sum(float(model.weights[b]) for b in toxicity.buckets(w)) for w in re.findall(r"[^\W_]+", s)]
            if any(found):
                none *= 1 - 1 / (1 + np.exp(-np.clip(sum(found) + model.start, -30, 30)))
        if 1 - none < 0.5:
            kept.add(r)
    assert set(after) == kept
    known = {r.doc_id: r for r in labels.collect()}
    stays = {r.doc_id for r in stages["toxicity"][1]}
    good = [i for i, r in known.items() if r.quality == 1 and r.toxic == 0 and i in {d.doc_id for d in stages["quality"][0]}]
    assert np.mean([i in stays for i in good]) >= 0.98


def test_one_of_each_class_by_all_pairs(stages):
    before, after = stages["near_duplicates"]
    sets = {}
    for r in before:
        w = re.findall(r"[^\W_]+", (r.text or "").lower())
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(4, 5):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in after) == sorted(i for i in ids if find(i) == i)
    assert set(after) <= set(before) and len(after) < len(before)


def test_surrogates_and_lengths(spark, stages):
    before, after = stages["personal_data"]
    turns = {(r.kind, r.canonical): (r.turn, r.gender) for r in pii.redrawn(frame(spark, before), queries.KEY).collect()}
    got = {r.doc_id: r for r in after}
    assert len(got) == len(before)
    for r in before:
        text = pii.rewritten(r.text, queries.KEY, turns)[0] if r.text else r.text
        new = got[r.doc_id]
        assert new.text == text and (new.lang, new.source) == (r.lang, r.source) and new.n_chars == (len(text) if text is not None else r.n_chars)


def test_packed_ids_are_the_librarys(stages):
    before, after = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in before}
    by: dict = {}
    for p in sorted(after, key=lambda p: (p.doc_id, p.piece)):
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length <= 1024 and zlib.crc32(np.array(part, dtype="<u4").tobytes()) == p.ids_crc32
        by.setdefault(p.doc_id, []).append(p)
    assert by.keys() == ids.keys()
    for d, pieces in by.items():
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]] and sum(p.length for p in pieces) == len(ids[d])
        assert all(p.length == 1024 for p in pieces[1:])
    bins: dict = {}
    for p in after:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(map(len, ids.values())) // 1024) + 2


def test_tables_that_are_odd(spark, tmp_path):
    """Null ids, texts and columns, repeated rows, no labels, no rows: every stage gives its columns and does not fail."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "same words here " * 9, "en", "s", 9), (2, "same words here " * 9, "en", "s", 9), (3, "same words here " * 9, None, None, None), (4, "mail a@b.org " + "x" * 30_000, "en", "s", 1)]
    for given in (rows, []):
        path = f"{tmp_path}/{len(given)}"
        spark.createDataFrame(given, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        got = corpus_pipeline.run(spark, path).collect()
        assert {r.doc_id for r in got} == ({None, 1, 2, 4} if given else set())
