"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed runs of five words; equal sets are one class of copies and are handled once, through
the least id.  A set has 160 MinHash values by one permutation: its least hash in each of 160 equal ranges, an empty
range taking the value of another by a fixed order of its own (optimal densification), so that each value agrees with
the similarity as its probability.  Classes whose values agree on one of 32 bands of five meet in a bucket (a pair of
similarity 0.8 is missed with probability 3e-6); a bucket is worked off in tiles of bounded size, never as rows of
pairs.  In a tile, values are compared 16 at a time, and a pair is dropped as soon as the posterior probability that
its similarity reaches the threshold (uniform prior, binomial likelihood) falls below the tolerance.  What remains links
groups of candidates; only their texts are read again, and inside each group, tile by tile, every pair that passes the
same pruning is verified exactly on the sets.

The result has one row per row of the input: ``doc_id``, ``class_id`` (the least id of the documents connected by
links), ``copy_id`` (the least id with the same set) and ``n_links`` (other rows at or above the threshold, copies
included).  Texts without words, null ones too, are classes of their own without links.  Texts of fewer than five
words are one run.  Inside, a row goes by a key hashed from its id and text, so that null ids and one id on several
texts are rows like others; null ids never name a class (``class_id`` and ``copy_id`` are null where all ids are).  Further columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import pairwise
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, connected_components, materialise, mix64, new_name, rows_of, shingle_hashes, text_or_empty, words_of

BANDS, ROWS, STEP, TOLERANCE, TILE, WORDS, THRESHOLD = 32, 5, 16, 1e-7, 256, 5, 0.8
VALUES = BANDS * ROWS
#: Where the ranges of hashes begin, and for each range the order in which it looks at the others when it is empty.
RANGES = np.array([-(-(k << 64) // VALUES) for k in range(VALUES)], dtype=np.uint64)
LOOKS = np.argsort(mix64(np.arange(VALUES * VALUES, dtype=np.uint64) + np.uint64(1)).reshape(VALUES, VALUES), axis=1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of values compared so far, the fewest matches with which a pair stays.

    With a uniform prior, m matches of n give the similarity a Beta(m + 1, n - m + 1) posterior, whose mass above the
    threshold is the chance of at most m successes in n + 1 trials of that probability.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


_words = WordHashes()


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """The sorted distinct hashed word runs of a text."""
    return np.unique(shingle_hashes(_words.of(words_of(text)), size))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (rows: sorted distinct hashes, none empty) as unsigned 16-bit numbers."""
    out = np.empty((len(sets), VALUES), dtype=np.uint64)
    for i, s in enumerate(sets):
        begin = np.searchsorted(s, RANGES)
        empty = np.flatnonzero(np.diff(begin, append=len(s)) == 0)
        if len(empty):
            full = np.ones(VALUES, dtype=bool)
            full[empty] = False
            begin[empty] = begin[LOOKS[empty, np.argmax(full[LOOKS[empty]], axis=1)]]
        out[i] = s[begin]
    return (mix64(out) >> np.uint64(48)).astype(np.uint16)


def band_keys(signature: np.ndarray) -> np.ndarray:
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
    for j in range(ROWS):
        key = mix64(key ^ signature[:, j::ROWS].astype(np.uint64))
    return key.view(np.int64)


def row_key(id_column: str) -> Column:
    """A row's key, the same wherever the row is read; rows that share it share id and text."""
    return F.xxhash64(F.col(id_column).cast("long"), text_or_empty())


def signed_documents(docs: DataFrame, id_column: str, words: int) -> DataFrame:
    """(id, row, a, b, signature): the set's 128-bit fingerprint, null without words, and its MinHash values."""

    def run(batches):
        for batch in rows_of(batches, 1000):
            sets = [shingles(x, words) for x in batch.column(2).to_pylist()]
            full = [s for s in sets if len(s)]
            values = iter(signatures(full) if full else [])
            prints = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in sets]
            half = lambda x, k: None if x is None else ((x >> k) & ((1 << 64) - 1)) - (1 << 63)
            cols = [pa.array([half(p, 64) for p in prints], pa.int64()), pa.array([half(p, 0) for p in prints], pa.int64()), pa.array([next(values).tobytes() if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], names=["id", "row", "a", "b", "signature"])

    return docs.select(F.col(id_column).cast("long").alias("id"), row_key(id_column).alias("row"), text_or_empty().alias("text")).mapInArrow(run, "id long, row long, a long, b long, signature binary")


def tiled(members: DataFrame, key: str, size: str) -> DataFrame:
    """``members`` of groups (``key``, with their number ``size``), dealt to tiles (key, lo, hi) of two blocks of about ``TILE`` at most."""
    rows = members.withColumn("blocks", F.ceil(F.col(size) / TILE).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other", size)


def groups(batches, keys: int):
    """Runs of rows with equal values in the first ``keys`` columns, of batches sorted by these, as lists of columns."""
    held: list[pa.RecordBatch] = []

    def joined():
        return pa.Table.from_batches(held).combine_chunks()

    def same(x, y):
        return all(x.column(i)[-1] == y.column(i)[0] for i in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in codes:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            part = batch.slice(a, b - a)
            if held and not (a == 0 and same(held[-1], part)):
                yield joined()
                held.clear()
            held.append(part)
    if held:
        yield joined()


def pair_indices(block: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a tile: all within one block, or those across two."""
    if lo == hi:
        return np.triu_indices(len(block), 1)
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def pruned(signature: np.ndarray, i: np.ndarray, j: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Positions of the pairs that the incremental comparison keeps."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), dtype=np.int64)
    for step, least in enumerate(bounds):
        columns = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (signature[i[alive], columns] == signature[j[alive], columns]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node connected with it."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sets: by counting matrix, or pair by pair where there are few."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    values, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.cumsum(count > 1) - 1
    keep = count[where] > 1
    owner, where = owner[keep], shared[where[keep]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    total, width = np.zeros((len(sets), len(sets)), dtype=np.float32), 8192
    for at in range(0, int(where[-1]) + 1 if len(where) else 0, width):
        a, b = np.searchsorted(where, [at, at + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[a:b], where[a:b] - at] = 1
        total += part @ part.T  # counts stay far below 2^24
    return total[i, j].astype(np.int64)


def candidate_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): a forest over the classes that the pruning leaves connected."""
    bounds = least_matches(threshold)

    def keys(batches):
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, VALUES)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(values))), pa.array(band_keys(values).ravel())], names=["rep", "band", "key"])

    buckets = materialise(reps.select("rep", "signature").mapInArrow(keys, "rep long, band int, key long"), "buckets", "lz4")
    full = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = buckets.join(full, ["band", "key"])
    tiles = tiled(members, "key", "members").join(reps.select("rep", "signature"), "rep")
    ordered = tiles.select("band", "key", "lo", "hi", "block", "rep", "signature").repartition("band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi", "rep")

    def compare(batches):
        for g in groups(batches, 4):
            band, lo, hi = g.column("band")[0].as_py(), g.column("lo")[0].as_py(), g.column("hi")[0].as_py()
            i, j = pair_indices(g.column("block").to_numpy(), lo, hi)
            values = np.frombuffer(b"".join(g.column("signature").to_pylist()), np.uint16).reshape(-1, VALUES)
            src, dst = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            kept = []
            for at in range(0, len(i), 1 << 15):
                a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                on = pruned(values, a, b, bounds)
                if band and len(on):  # a pair that met in an earlier band was kept there
                    met = (values[a[on], : band * ROWS] == values[b[on], : band * ROWS]).reshape(len(on), band, ROWS).all(axis=2).any(axis=1)
                    on = on[~met]
                kept.append((a[on], b[on]))
            a, b = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.empty(0, int), np.empty(0, int))
            if len(a):
                rep, label = g.column("rep").to_numpy(), roots(len(values), a, b)
                moved = np.flatnonzero(label != np.arange(len(label)))
                src, dst = [rep[moved]], [rep[label[moved]]]
            yield pa.RecordBatch.from_arrays([pa.array(src[0]), pa.array(dst[0])], names=["src", "dst"])

    return ordered.mapInArrow(compare, "src long, dst long").filter("src <> dst").distinct()


def verified_links(docs: DataFrame, id_column: str, reps: DataFrame, edges: DataFrame, threshold: float, words: int) -> DataFrame:
    """(rep, links, root): per class and tile the copies linked with it, and the least class of its links there."""
    t, bounds = Fraction(threshold).limit_denominator(10**6), least_matches(threshold)
    group = materialise(connected_components(edges).withColumnRenamed("node", "rep"), "candidates")
    # Stored before it is joined, so that Spark can split the partition of a very large group.
    sizes = materialise(group.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "sizes")
    members = group.join(sizes, "component").join(reps.select("rep", "copies"), "rep")
    # Texts of candidates only: the semi-join is broadcast while these are few, and filters by a bloom filter before the
    # shuffle where Spark finds that worth while.  Rows that share a key share their text; they are one before they meet in a task.
    texts = docs.select(row_key(id_column).alias("rep"), text_or_empty().alias("text")).join(group.select("rep"), "rep", "left_semi")
    texts = texts.groupBy("rep").agg(F.first("text").alias("text")).join(members, "rep").select("rep", "component", "members", "copies", "text")

    def with_sets(batches):
        for batch in rows_of(batches, 1000):
            sets = [shingles(x, words).tobytes() for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], names=[*batch.schema.names[:4], "hashes"])

    sets = texts.mapInArrow(with_sets, "rep long, component long, members long, copies long, hashes binary")
    tiles = tiled(sets, "component", "members").select("component", "lo", "hi", "block", "rep", "copies", "hashes")
    ordered = tiles.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "rep")

    def verify(batches):
        for g in groups(batches, 3):
            lo, hi = g.column("lo")[0].as_py(), g.column("hi")[0].as_py()
            rep, copies = g.column("rep").to_numpy(), g.column("copies").to_numpy()
            own = [np.frombuffer(x, np.uint64) for x in g.column("hashes").to_pylist()]
            i, j = pair_indices(g.column("block").to_numpy(), lo, hi)
            on = pruned(signatures(own), i, j, bounds) if len(i) else np.empty(0, dtype=int)
            i, j = i[on], j[on]
            size = np.array([len(s) for s in own])
            both = intersections(own, i, j) if len(i) else np.empty(0, dtype=int)
            good = both * t.denominator >= (size[i] + size[j] - both) * t.numerator
            i, j = i[good], j[good]
            links = np.zeros(len(rep), dtype=np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(rep[roots(len(rep), i, j)])], names=["rep", "links", "root"])

    return ordered.mapInArrow(verify, "rep long, links long, root long")


def joined_rows(docs: DataFrame, id_column: str, threshold: float, words: int) -> DataFrame:
    """(id, row, copy, first, n_links) of every row: the first (no_id, id, row) of its copies and of its class, null without words."""
    signed = materialise(signed_documents(docs, id_column, words), "signed")
    copy = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("copy")
    classes = signed.filter("a is not null").groupBy("a", "b").agg(F.min("row").alias("rep"), copy, F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"))
    reps = materialise(classes, "classes")
    edges = materialise(candidate_edges(reps, threshold), "edges")
    links = materialise(verified_links(docs, id_column, reps, edges, threshold, words), "links")
    component = connected_components(links.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep")
    component = materialise(component.join(reps.select("rep", "copy"), "rep"), "components")
    least = materialise(component.groupBy("component").agg(F.min("copy").alias("first")), "least")  # stored for the same reason as the sizes
    component = component.join(least, "component").select("rep", "first")
    by_rep = links.groupBy("rep").agg(F.sum("links").alias("links")).join(component, "rep", "left")
    known = reps.select("a", "b", "rep", "copy", "copies").join(by_rep, "rep", "left")
    result = signed.select("id", "row", "a", "b").join(known, ["a", "b"], "left")
    links = (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long")
    return result.select("id", "row", "copy", F.coalesce("first", "copy").alias("first"), links.alias("n_links"))


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_id, n_links."""
    rows = joined_rows(docs, id_column, threshold, words)
    return rows.select(F.col("id").alias("doc_id"), F.coalesce("first.id", "id").alias("class_id"), F.coalesce("copy.id", "id").alias("copy_id"), "n_links")


def keep_first(docs: DataFrame, id_column: str = "doc_id", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each class, that of the least id; rows that share id and text are one, but for those without both."""
    rows = joined_rows(docs, id_column, threshold, words)
    alone = F.col("id").isNull() & F.col("first").isNull()
    found = materialise(rows.select("id", "row", alone.alias("alone"), F.coalesce(F.col("row") != F.col("first.row"), F.lit(False)).alias("gone")), "found")
    own = new_name(docs, "row")
    keyed = docs.withColumn(own, row_key(id_column))
    # What goes grows with the corpus, so it is merged at every size.
    kept = keyed.join(found.filter("gone").select(F.col("row").alias(own)).distinct().hint("merge"), own, "left_anti")
    twice = found.filter("not alone and not gone").groupBy(F.col("row").alias(own)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(own)
    if twice.limit(1).count():
        kept = kept.join(twice, own, "left_anti").unionByName(kept.join(twice, own, "left_semi").dropDuplicates([own]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
