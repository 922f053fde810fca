"""Stupid-backoff language-model scores, computed as joins of count tables with the documents' n-grams.

Every order's n-grams are counted over all documents.  A document is scored by the counts of the others (its own are
taken off), else the model would know every text by heart: a token's score is c(gram) / c(context) if the gram occurs
elsewhere, else 0.4 times the score of the shorter gram, and at last (c(token) + 1) / (N + V + 1), with N tokens and V distinct
tokens of the other documents.  A document's score is the mean natural logarithm over its tokens.

How it runs: documents are stored as blocks of word hashes.  The distinct n-grams of a block are dealt with their counts
to parts by their hash, one row of arrays for each block and part, and exploded to rows (gram, block, n) there.  A
window over the n-gram sums the count table of a part and joins it with those rows in one sort, since each n-gram is in
one part only.  The counts go back to the blocks, in order of the n-grams, and there the logarithms are summed per
document.  A frequent n-gram is one row per block, however many documents hold it; there are never more rows than
n-grams of blocks, and what a task reads does not grow with the corpus.

Words are runs of letters and digits, lower-cased.  Texts without words, null and empty ones too, have no tokens and a
null score.  Repeated rows are documents of their own.  Further columns are ignored.  An empty table gives an empty
result.  N-grams of one order are told apart by 61-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, materialise, mix64, text_or_empty, words_of

BACKOFF, BLOCK_WORDS, PART_WORDS, TASK_PARTS, MOST_ORDER = 0.4, 1_200_000, 400_000, 3, 8
_words = WordHashes()


def grams(words: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``order`` words that end at each word, the order in the last three bits, and whether there is one within the document."""
    out = np.full(len(words), order, dtype=np.uint64)
    for i in range(order - 1, -1, -1):
        shifted = np.concatenate([np.zeros(min(i, len(words)), dtype=np.uint64), words[: max(0, len(words) - i)]])
        out = mix64(out ^ shifted)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return out & ~np.uint64(7) | np.uint64(order - 1), place >= order - 1


def stored_blocks(docs: DataFrame, id_column: str) -> DataFrame:
    """(block, ids, known, sizes, words, n): documents as arrays, in blocks of about ``BLOCK_WORDS`` words, a document at least.

    ``known`` tells which ids are not null.  ``words`` are indices into ``hashes``, the block's distinct word hashes, the
    most frequent first; they are stored byte by byte, all lowest ones first, and compressed, since blocks are shuffled.
    """
    schema = "block long, n long, ids binary, known binary, sizes binary, hashes binary, words binary"

    def run(batches):
        task, made, ids, arrays, n = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            flat = np.concatenate(arrays)
            hashes, index, count = np.unique(flat, return_inverse=True, return_counts=True)
            order, rank = np.argsort(-count, kind="stable"), np.empty(len(hashes), dtype=np.int64)
            rank[order] = np.arange(len(hashes))
            hashes, index = hashes[order], rank[index]
            row = [task << 32 | made, len(flat), np.array([i or 0 for i in ids], dtype=np.int64).tobytes(), bytes(i is not None for i in ids), np.array([len(a) for a in arrays], dtype=np.int64).tobytes(), hashes.tobytes(), zstandard.compress(index.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.int64(), *[pa.binary()] * 5], strict=True)], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                arrays.append(_words.of(words_of(text)))
                n += len(arrays[-1])
                if n >= BLOCK_WORDS:
                    yield block()
                    made, ids, arrays, n = made + 1, [], [], 0
        if ids:
            yield block()

    return materialise(docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty().alias("text")).mapInArrow(run, schema), "blocks")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, word hashes) of a stored block."""
    hashes = np.frombuffer(row["hashes"], np.uint64)
    index = np.frombuffer(zstandard.decompress(row["words"]), np.uint8).reshape(4, -1).T
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64), hashes[np.ascontiguousarray(index).view("<u4").ravel()]


def small(counts: np.ndarray) -> bytes:
    """Counts in the least unsigned type that holds them, its width first."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(counts) or counts.max() <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def unsmall(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each n-gram: ``parts`` ranges of hashes of the same width."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def dealt(words: np.ndarray, sizes: np.ndarray, order: int, parts: int):
    """For each order up to ``order``: it, the sorted distinct n-grams, which one ends at each place that has one, those places, their counts, and their parts, which are sorted too."""
    for k in range(1, order + 1):
        hashes, there = grams(words, sizes, k)
        found, where, count = np.unique(hashes[there], return_inverse=True, return_counts=True)
        yield k, found, where, there, count, part_of(found, parts)


def exploded(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, block, gram, n): the distinct n-grams of each block, of all orders up to ``order``, and how often it holds them; all rows of a part are in one partition."""
    names = ["part", "block", "grams", "ns"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, sizes, words = unpack(row)
                for _, found, _, _, count, part in dealt(words, sizes, order, parts):
                    begin = np.flatnonzero(np.diff(part, prepend=-1))  # of the parts that the block has n-grams of
                    places = pa.array(np.append(begin, len(part)), pa.int32())
                    lists = [pa.ListArray.from_arrays(places, pa.array(x)) for x in (found.view(np.int64), count.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([pa.array(part[begin], pa.int32()), pa.array(np.full(len(begin), row["block"]), pa.int64()), *lists], names=names)

    packed = blocks.select("block", "ids", "sizes", "hashes", "words").mapInArrow(run, "part int, block long, grams array<long>, ns array<int>")
    return packed.repartition(max(1, parts // TASK_PARTS), "part").select("part", "block", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("ns").alias("n"))).alias("gram", "n"))


def distinct_words(blocks: DataFrame) -> int:
    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, np.int64))], names=["word"])

    return blocks.select("hashes").mapInArrow(run, "word long").distinct().count()


def backoff_scores(docs: DataFrame, order: int = 3, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, score) of every document."""
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"an order of 1 to {MOST_ORDER} is expected")
    blocks = stored_blocks(docs, id_column)
    total = blocks.agg(F.sum("n")).first()[0] or 0
    vocabulary = distinct_words(blocks)
    parts = max(1, math.ceil(total / PART_WORDS))
    counted = exploded(blocks, order, parts).withColumn("total", F.sum("n").over(Window.partitionBy("part", "gram")))

    def bundle(batches):
        held = [[batch.column(i).to_numpy() for i in range(4)] for batch in batches if batch.num_rows]
        if not held:
            return
        part, block, gram, others = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((gram.view(np.uint64), block, part))
        part, block, others = part[by], block[by], others[by]
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(part) != 0)]))
        for some in np.array_split(begin, -(-len(begin) // 1000)):
            ends = np.append(begin, len(by))[np.searchsorted(begin, some) + 1]
            yield pa.RecordBatch.from_arrays([pa.array(part[some]), pa.array(block[some]), pa.array([small(others[i:j]) for i, j in zip(some, ends, strict=True)], pa.binary())], names=["part", "block", "others"])

    found = counted.select("part", "block", "gram", (F.col("total") - F.col("n")).alias("others")).mapInArrow(bundle, "part int, block long, others binary")

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        ids, sizes, words = unpack(row)
        # A part's answers are those for the unigrams, bigrams and so on together, in order of their hashes.
        told = dict(zip(answers.column("part").to_pylist(), map(unsmall, answers.column("others").to_pylist()), strict=True))
        asked = list(dealt(words, sizes, order, parts))
        elsewhere = [np.zeros(len(found), dtype=np.int64) for _, found, *_ in asked]
        for p, others in told.items():
            at = [np.searchsorted(part, [p, p + 1]) for *_, part in asked]
            own = np.concatenate([found[i:j] for (i, j), (_, found, *_) in zip(at, asked, strict=True)])
            kind = np.repeat(np.arange(order), [j - i for i, j in at])
            by = np.argsort(own)
            mixed = np.empty(len(own), dtype=np.int64)
            mixed[by] = others
            for k, (i, j) in enumerate(at):
                elsewhere[k][i:j] = mixed[kind == k]
        owner = np.repeat(np.arange(len(ids)), sizes)
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        counts = {}
        for (k, _, where, there, own_block, _), more in zip(asked, elsewhere, strict=True):
            _, back, own = np.unique(where.astype(np.int64) * len(ids) + owner[there], return_inverse=True, return_counts=True)
            counts[k] = np.zeros(len(words), dtype=np.int64)
            counts[k][there] = (own_block + more)[where] - own[back]
        value, open_, factor = np.zeros(len(words)), np.ones(len(words), dtype=bool), np.zeros(len(words))
        for k in range(order, 1, -1):
            context = np.zeros(len(words), dtype=np.int64)
            context[1:] = counts[k - 1][:-1]  # the gram of order k - 1 that ends one word before
            hit = open_ & (counts[k] > 0)
            value[hit] = factor[hit] + np.log(counts[k][hit] / context[hit])
            open_ &= ~hit
            factor[open_ & (place >= k - 1)] += math.log(BACKOFF)
        value[open_] = factor[open_] + np.log((counts[1][open_] + 1) / (total - sizes[owner][open_] + vocabulary + 1))
        with np.errstate(invalid="ignore"):
            mean = np.bincount(owner, value, len(ids)) / sizes
        return pa.table([pa.array(ids, mask=np.frombuffer(row["known"], np.uint8) == 0), pa.array(sizes), pa.array(mean, mask=sizes == 0)], names=["doc_id", "n_words", "score"])

    tasks = max(1, math.ceil(2 * total / BLOCK_WORDS))  # so many that few blocks meet
    mine, theirs = (x.repartition(tasks, "block").groupBy("block") for x in (blocks.drop("n"), found))
    return mine.cogroup(theirs).applyInArrow(score, "doc_id long, n_words long, score double")
