"""Held-out quality of the fitted models, surrogates, backoff scores by brute force, and the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainfit.llm import lm, pii, quality, toxicity

KEY = b"test"


def word(rng):
    return "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 7))))


def labelled(rng, n=400):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 4 == 1
        words = [word(rng) for _ in range(int(rng.integers(30, 80)))]
        sentences = [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
        if toxic:
            k = int(rng.integers(len(sentences)))
            sentences[k] += " zzvile" + word(rng)
        text = ". ".join(sentences) + "."
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, "x"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = labelled(np.random.default_rng(4))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "  \n ", "x"), (1003, "word " * 30000, "x")]
    labels += [(1000, 1, 0), (2000, 1, 1), (1001, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ordinal_model_separates_held_out_grades(spark, tables):
    docs, labels = tables
    model = quality.fit_quality(docs, labels.filter("doc_id % 3 <> 0"), F.col("quality") * (2 - F.col("toxic")), 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.score_quality(docs, model)
    assert got.columns == ["doc_id", "text", "score", "expected_grade", "tail_probability"]
    held = got.join(labels, "doc_id").filter("doc_id % 3 = 0 and doc_id < 1000").collect()
    right = [(r.tail_probability >= 0.5) == (r.quality == 1) for r in held]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= r.expected_grade <= 2 for r in held)
    assert got.filter("doc_id >= 1000").count() == 4
    none = quality.fit_quality(docs, labels.limit(0), F.col("quality"), 2)
    assert quality.score_quality(docs, none).filter("tail_probability < 0.5").count() == 0
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_noisy_or_finds_the_offending_sentence(spark, tables):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels.filter("doc_id % 3 <> 0"), F.col("toxic"))
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, model).collect()}
    held = [r for r in labels.collect() if r.doc_id % 3 == 0 and r.doc_id < 1000]
    right = [(got[r.doc_id] >= 0.5) == bool(r.toxic) for r in held]
    assert sum(right) >= 0.95 * len(right)
    assert got[1000] == got[1001] == got[1002] == 0 and all(0 <= v <= 1 for v in got.values())
    places = toxicity.locate(docs, model).filter("doc_id < 1000").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert places and all(texts[p.doc_id][p.begin : p.end] == p.sentence for p in places)
    assert sum("zzvile" in p.sentence.lower() for p in places) >= 0.95 * len(places)
    none = toxicity.fit_toxicity(docs, labels.limit(0), F.col("toxic"))
    assert toxicity.score_toxicity(docs, none).filter("toxicity >= 0.5").count() == 0


TEXT = 'Mail be.06@mail7.example.com or BE.06@MAIL7.EXAMPLE.COM, call +1 (603) 555-8791, card 4111 1111 1111 1111, 5157452173657494, host 230.40.1.146, 999.1.1.1, iban GB82 WEST 1234 5698 7654 32, token = "5d190bd7c06284de91015a36974748794293dd8a", Mrs. Anna Schmidt met Dr. Brown; Schmidt left. 078-05-1120. Анна Петрова. The year 1999, 3.14, v1.2.3.'


def test_surrogates_keep_type_format_and_coreference():
    new, n = pii.rewritten(TEXT, KEY, {})
    kinds = Counter(k for _, _, k, _ in pii.detect(TEXT))
    assert kinds == {"email": 2, "phone": 1, "card": 2, "ip": 1, "iban": 1, "secret": 1, "given-f": 2, "family": 4, "ssn": 1} and n == 15
    for gone in ("be.06", "mail7", "555-8791", "4111 1111", "5157452173657494", "230.40.1.146", "WEST", "5d190bd7", "Schmidt", "Brown", "078-05-1120", "Петрова"):
        assert gone not in new
    for stays in ("999.1.1.1", "The year 1999, 3.14, v1.2.3.", "Mrs. ", "Dr. ", "token = "):
        assert stays in new
    mails = re.findall(r"[\w.]+@[\w.]+", new)
    assert mails[0] == mails[1].lower() and mails[1].isupper()
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4},", new)
    assert pii.luhn(re.search(r"card (\d{4} \d{4} \d{4} \d{4})", new)[1].replace(" ", "")) and pii.luhn("5157452173657494") == pii.luhn(re.search(r", (\d{16}),", new)[1])
    assert pii.mod97(re.search(r"iban (GB[\w ]+),", new)[1].replace(" ", "")) == 1
    family = re.search(r"Mrs\. (\w+) (\w+) met", new)
    assert f"; {family[2]} left" in new
    assert re.search(r"[а-яё]+[аи]?на?\b|[А-Я][а-я]+а", new)
    assert pii.rewritten(TEXT, KEY, {})[0] == new != pii.rewritten(TEXT, b"other", {})[0]


def test_a_phone_number_is_replaced_alike_however_it_is_written():
    written = ("+1 (415) 555-8791", "+1 415 555-8791", "+1-415-555-8791")
    digits = {re.sub(r"\D", "", pii.rewritten(f"call {x} now", KEY, {})[0]) for x in written}
    assert len(digits) == 1 and len(*digits) == 11 and digits.pop()[0] == "1"


@pytest.mark.parametrize("most", [1000, 0])
def test_collisions_draw_again_until_all_are_distinct(spark, most):
    """Two-digit local parts in one domain must collide; both ways of looking up the repeats give distinct results."""
    mails = [f"a{i}@x.org" for i in range(10)] + [f"b{i}@x.org" for i in range(10)]
    rows = [(i, f"write to {m} now {mails[0]}", 7) for i, m in enumerate(mails * 2)] + [(100, None, 7), (101, "", 7), (102, "clean text", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    first = Counter(pii.surrogate(KEY, "email", m) for m in mails)
    got = {r.doc_id: r for r in pii.replace_pii(docs, KEY, most_broadcast=most).collect()}
    assert len(got) == 43 and got[100].text is None and got[101].text == "" and got[102].text == "clean text" and got[102].n_entities == 0
    new = [re.findall(r"\S+@\S+", got[i].text) for i in range(40)]
    assert len({x[0] for x in new}) == 20 and len({x[1] for x in new}) == 1
    assert all(new[i] == new[i + 20] for i in range(20)) and got[5].kind == 7 and got[5].n_entities == 2
    again = pii.redrawn(docs, KEY).collect()
    assert len(again) >= sum(n - 1 for n in first.values())


def test_backoff_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_WORDS", 40)
    monkeypatch.setattr(lm, "PART_WORDS", 60)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 30)))) for _ in range(40)] + [None, "", "!!", "only here", "a b c", "a b c"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int").repartition(3)
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    for order in (1, 2, 3):
        got = {r.doc_id: r for r in lm.backoff_scores(docs, order).collect()}
        grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        corpus = {k: sum((grams(w, k) for w in words), Counter()) for k in range(1, order + 1)}
        for i, w in enumerate(words):
            own = {k: grams(w, k) for k in corpus}
            c = lambda g: corpus[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
            total = 0.0
            for j in range(len(w)):
                factor = 0.0
                for k in range(min(order, j + 1), 1, -1):
                    g = tuple(w[j - k + 1 : j + 1])
                    if c(g):
                        total += factor + math.log(c(g) / c(g[:-1]))
                        break
                    factor += math.log(0.4)
                else:
                    total += factor + math.log((c((w[j],)) + 1) / (sum(map(len, words)) - len(w) + len(corpus[1]) + 1))
            assert got[i].n_words == len(w)
            assert got[i].score is None if not w else got[i].score == pytest.approx(total / len(w))
    assert lm.backoff_scores(docs.limit(0)).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    kept, stage = docs, {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(f(spark, kept, sf).collect(), docs.schema)
        stage[name] = {r.doc_id: r.text for r in kept.collect()}
        assert kept.count() == len(stage[name])
    assert ids > set(stage["quality"]) >= set(stage["toxicity"]) >= set(stage["near_duplicates"]) == set(stage["personal_data"])
    assert not any("@mail" in t for t in stage["personal_data"].values())
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == set(stage["personal_data"])
