"""Importance resampling towards a target: documents are drawn by how much their words look like the target's.

Features are runs of 1 to ``most`` consecutive words; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo the
number of buckets.  Documents and targets are counted by bucket, a bucket's gain is the logarithm of its smoothed share
in the target over that in the documents, a document's weight is the mean gain of its features, and weights with Gumbel
noise, which depends on the id only, are drawn from the top: sampling without replacement in one sort.

Words are found by an Aho-Corasick automaton over a dictionary.  Texts are brought to one space between words, each word
of the dictionary is a pattern with a space on both sides, so that a match is a whole word, and carries its CRC, its
bytes and its characters as payload.  The scan emits payloads in order of the text; what lies between two matches that
don't meet are words outside the dictionary, which are hashed one by one.  So the dictionary, at most ``DICTIONARY`` of
the most frequent words of all documents with at most ``LONGEST`` bytes, makes no difference to results, and its size is bounded.
Runs of words are never put together as text: the CRC of a run is composed from those of its parts, whose lengths say
how far to shift.

Words' buckets are stored once, two bytes each; counts leave a task as one row a bucket, and gains are one number a
bucket.  Null and empty texts have no words and weight 0.  Documents with null ids have no score and aren't drawn.
Repeated rows are documents of their own, each of which may be drawn.  Texts are scanned as wholes, however long.
Further columns are ignored.  Without documents the result is empty; without target texts all shares there are equal.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import running
from .common import materialise, rows_of, text_or_empty

DICTIONARY, LONGEST, HELD = 1 << 16, 64, 200_000
#: Upper-case ASCII letters to lower case, and all ASCII but letters and digits to spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPACE_CRC = np.uint32(zlib.crc32(b" "))


def words_of(text: str) -> bytes:
    """The words of a text with one space between them."""
    return b" ".join(text.encode().translate(WORD_BYTES).split())


def _shifts() -> np.ndarray:
    """For each power of two, four tables that shift the CRC by so many zero bytes, one for each of its own bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    step = lambda crc: table[crc & 255] ^ crc >> 8
    byte = np.arange(256, dtype=np.uint32)
    out = [np.stack([step(byte << np.uint32(8 * k)) for k in range(4)])]
    for _ in range(31):
        last = out[-1]
        out.append(_shifted(last, last))
    return np.stack(out)


def _shifted(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


SHIFTS = _shifts()


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of two strings put together, from their CRCs and the length of the second."""
    left, bit = left.copy(), 0
    while (more := length >> bit).any():
        at = np.flatnonzero(more & 1)
        left[at] = _shifted(SHIFTS[bit], left[at])
        bit += 1
    return left ^ right


class Dictionary:
    """The automaton over the given words (bytes, at most ``LONGEST`` long)."""

    def __init__(self, words: list[bytes]):
        self.automaton = ahocorasick.Automaton()  # payloads need more than the 32 bits of its own integers
        for w in words:
            self.automaton.add_word(f" {(s := w.decode())} ", zlib.crc32(w) << 16 | len(w) << 8 | len(s))
        if words:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The CRC and the number of bytes of each word, in order."""
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        text = f" {words.decode()} "
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2) if len(self.automaton) else np.empty((0, 2), np.int64)
        end, payload = found[:, 0], found[:, 1]
        crc, length = (payload >> 16).astype(np.uint32), payload >> 8 & 255
        begin, before = np.append(end - (payload & 255) - 1, len(text) - 1), np.append(0, end)
        gaps = np.flatnonzero(begin > before)
        if len(gaps):
            others = [text[a + 1 : b].encode().split(b" ") for a, b in zip(before[gaps].tolist(), begin[gaps].tolist(), strict=True)]
            at = np.repeat(gaps, list(map(len, others)))
            others = list(chain.from_iterable(others))
            crc = np.insert(crc, at, np.fromiter(map(zlib.crc32, others), np.uint32, len(others)))
            length = np.insert(length, at, np.fromiter(map(len, others), np.int64, len(others)))
        return crc, length


def features(crc: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """The CRCs of all runs of 1 to ``most`` words."""
    out, run = [crc], crc
    for k in range(1, min(most, len(crc))):
        run = composed(composed(run[:-1], SPACE_CRC, np.ones(len(run) - 1, np.int64)), crc[k:], length[k:])
        out.append(run)
    return np.concatenate(out)


def frequent_words(docs: DataFrame, size: int = DICTIONARY) -> list[bytes]:
    """The most frequent words of at most ``LONGEST`` bytes, counted over all documents: as many steps of frequency, eight to a doubling, as fit into ``size``."""

    def run(batches):
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in rows_of(batches, 500):
            for text in batch.column(0).to_pylist():
                held.update(words_of(text).split())
                if len(held) > HELD:
                    yield rows()
                    held = Counter()
        yield rows()

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(run, "word binary, n long").filter(F.octet_length("word") <= LONGEST)
    step = F.floor(8 * F.log2("n"))
    known = materialise(counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").select("word", step.alias("step")), "words")
    least, room = None, size
    for r in known.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():  # eight rows for each doubling of the count
        if r.n > room:
            break
        least, room = r.step, room - r.n
    return [] if least is None else sorted(bytes(r.word) for r in known.filter(F.col("step") >= least).select("word").collect())  # at most 4 MB


_built: dict[int, Dictionary] = {}


def scanned(texts: DataFrame, words, key: int, most: int, buckets: int) -> DataFrame:
    """Stored rows (doc_id, n_words, buckets) of ``texts`` (id, text), and for each task one with counts, a long for each bucket."""
    dtype = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    names, kinds = ["doc_id", "n_words", "buckets", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        if key not in _built:  # one automaton for each worker
            _built.clear()
            _built[key] = Dictionary(words.value)
        dictionary, counts = _built[key], np.zeros(buckets, dtype=np.int64)
        for batch in rows_of(batches, 1000):
            n, packed = [], []
            for text in batch.column(1).to_pylist():
                crc, length = dictionary.scan(text)
                bucket = features(crc, length, most) % np.uint32(buckets)
                counts += np.bincount(bucket, minlength=buckets)
                n.append(len(crc))
                packed.append(bucket.astype(dtype).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, kinds[1]), pa.array(packed, kinds[2]), pa.nulls(len(n), kinds[3])], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, None, None, counts.tobytes()], kinds, strict=True)], names=names)

    return materialise(texts.mapInArrow(run, "doc_id long, n_words long, buckets binary, counts binary"), "features")


def bucket_counts(table: DataFrame, buckets: int) -> np.ndarray:
    """How many features of a scanned table are in each bucket: one row a bucket is collected."""

    def unpack(batches):
        for batch in batches:
            total = sum((np.frombuffer(x, dtype=np.int64) for x in batch.column(0).to_pylist()), np.zeros(buckets, dtype=np.int64))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counts = np.zeros(buckets, dtype=np.int64)
    for r in table.filter("counts is not null").select("counts").mapInArrow(unpack, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's floored thousandfold logarithm of its share in the target over that in the documents, both smoothed by one."""
    size, s, t = len(documents), float(documents.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + size) / ((a + 1.0) * (t + size)))) for a, b in zip(documents.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighted(docs: DataFrame, target: DataFrame, most: int, buckets: int, id_column: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document; ``target`` has a column ``text``."""
    dictionary = frequent_words(docs)
    words, key = docs.sparkSession.sparkContext.broadcast(dictionary), zlib.crc32(b" ".join(dictionary))
    own = scanned(docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text_or_empty().alias("text")), words, key, most, buckets)
    theirs = scanned(target.select(F.lit(None).cast("long").alias("doc_id"), text_or_empty().alias("text")), words, key, most, buckets)
    gain, width = gains(bucket_counts(own, buckets), bucket_counts(theirs, buckets)), 2 if buckets <= 1 << 16 else 4

    def run(batches):
        for batch in rows_of(batches, 2000):
            packed = batch.column(2).to_pylist()
            n = np.fromiter((len(p) // width for p in packed), np.int64, len(packed))
            total = np.append(0, np.cumsum(gain[np.frombuffer(b"".join(packed), f"<u{width}")]))
            ends = np.cumsum(n)
            weight = (total[ends] - total[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return own.filter("counts is null").select("doc_id", "n_words", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int, seed: int = 2024, most: int = 1, buckets: int = 10_000, least_words: int = 20, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``percent`` of the documents of at least ``least_words`` words are drawn and ranked."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighted(docs, target, most, buckets, id_column).withColumn("score", F.col("weight") + noise)
    scored = materialise(scored.withColumn("eligible", F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)), "scored")
    drawn = scored.filter("eligible").count() * percent // 100
    ranked = running(scored.filter("eligible").withColumn("down", -F.col("score")).withColumn("one", F.lit(1).cast("long")), ["down", "doc_id"], "one", "before")
    ranked = ranked.withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank").union(scored.filter("not eligible").select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))
