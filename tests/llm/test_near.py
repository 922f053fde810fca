import re
from fractions import Fraction

import numpy as np

from plainfit.llm import near


def brute(texts):
    """Links and classes by comparing all pairs of sets of five-word runs."""
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = {i: {j for j in ids if j != i and sets[i] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= Fraction(4, 5)} for i in ids}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (min(seen), min([i, *(j for j in links[i] if sets[j] == sets[i])]), len(links[i]))
    return out


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "...", "one", "One!", "two words", "a b c d e", "A, b; c d e."]
    base = rng.choice(vocabulary, 120).tolist()
    for _ in range(60):  # a large group of near copies and copies
        words = list(base)
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
        texts += [" ".join(words)] * int(rng.integers(1, 3))
    passage = " ".join(rng.choice(vocabulary, 60))
    for _ in range(60):
        own = rng.choice(vocabulary, int(rng.integers(5, 150))).tolist()
        texts += [" ".join(own), " ".join(own[:-1]), passage + " " + " ".join(own), " ".join(own + own[:2])]
    return list(enumerate(texts))


def test_links_and_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 16)  # several tiles for the large groups
    rows = corpus()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rep int, signature string").repartition(3)
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in near.jaccard_join(frame).collect()}
    want = brute(rows)
    assert got == want
    kept = {r.doc_id for r in near.keep_first(frame).collect()}
    assert kept == {i for i, (c, _, _) in want.items() if i == c}


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    frame = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in near.jaccard_join(frame).collect()) == [(1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 2), (3, 3, 3, 0)]
    assert sorted(r.doc_id for r in near.keep_first(frame).collect()) == [1, 3]
    assert near.jaccard_join(frame.limit(0)).count() == 0


def test_pruning_bounds_follow_the_posterior():
    bounds = near.least_matches(0.8, 1e-7)
    assert bounds == sorted(bounds) and len(bounds) == near.VALUES // near.STEP
    # numeric posterior mass above the threshold, uniform prior
    grid = np.linspace(0, 1, 200001)
    for step, least in enumerate(bounds):
        n = (step + 1) * near.STEP
        for m, stays in ((least, True), (least - 1, False)):
            if m >= 0:
                density = grid**m * (1 - grid) ** (n - m)
                assert (density[grid >= 0.8].sum() / density.sum() >= 1e-7) == stays


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    v = near.signatures([np.unique(a), np.unique(b)])
    assert abs((v[0] == v[1]).mean() - 800 / 1200) < 0.2
