"""Suffix-array dedup: remove every byte that lies in a string of ``length`` bytes which also starts elsewhere.

All windows of ``length`` bytes of all texts are compared, without a row for each of them.  Suffixes are taken at the
least hashed ``GRAM`` bytes of each window, its anchor, so equal windows have anchors at the same place in them; a run
of windows with one anchor is one suffix, and there are about two for each ``length - GRAM`` bytes.  A suffix has two
leading tokens: the hash of the bytes that all its windows share (its core) and that of all its bytes (its hull).
Sampled splitters deal the suffixes to buckets by their tokens, each bucket is sorted by multikey quicksort, and what
is cut by a boundary is compared across it.  Equal hulls decide a whole run of windows at once.  Equal cores under
different hulls are taken apart: the run of an anchor into runs of up to ``STEP`` windows, whose core is all but
``STEP`` bytes, and these at last into single windows, by the same sort.  So what is shuffled follows the number of
anchors and of borders between what repeats and what doesn't, and no key makes a large group: the block number is part
of the order, and a run of equal tokens may go over any number of buckets.

Texts are stored once as blocks of about ``BLOCK`` bytes, bucketed by block, so that answers move to texts and texts
stay.  Two tokens make 128 bits; strings that agree in both count as equal.

Null and empty texts have no bytes and lose none.  Null ids are kept.  Repeated rows are documents of their own, so
copies lose all windows.  A text longer than a block is a block of its own.  Further columns are ignored, and an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix64, rows_of, shared_path, text_or_empty

LENGTH, GRAM, STEP, BLOCK, BUCKET_ROWS, BUCKET_BYTES = 400, 64, 32, 1 << 19, 500_000, 1 << 26
#: Window starts that are scanned at a time, and the bits that hold a place among them.
SPAN, PLACE = 1 << 19, np.uint64((1 << 22) - 1)
#: ``spot`` holds the place of the anchor in its block, the greatest and the least distance of its windows' starts
#: before it, and whether the block has the suffix more than once.
DISTANCE = 15
MOST_LENGTH = 1 << DISTANCE - 1
BASE = 0x9E3779B97F4A7C15
TOKENS = "first long, second long, block long, spot long"
FOUND = "block long, start long, stop long"


class Hashes:
    """64-bit hashes of any substring of bytes, from powers that are made once for each worker."""

    def __init__(self, room: int):
        self.value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        self.up = self._powers(BASE, room)
        self.down = self._powers(pow(BASE, -1, 1 << 64), room)

    @staticmethod
    def _powers(base: int, room: int) -> np.ndarray:
        steps = np.full(room, base, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def prefixes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(self.value[x] * self.up[: len(x)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefixes[end] - prefixes[begin]) * self.down[begin])


_hashes: list[Hashes] = []


def hashes(room: int) -> Hashes:
    """This worker's powers, for substrings of blocks of ``room`` bytes."""
    if not _hashes or len(_hashes[0].up) < room:
        _hashes[:] = [Hashes(max(room, SPAN + MOST_LENGTH))]
    return _hashes[0]


def spot(place: np.ndarray, most: np.ndarray, least: np.ndarray, several: np.ndarray) -> np.ndarray:
    return ((place << DISTANCE | most) << DISTANCE | least) << 1 | several


def unspot(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, most, least) of spots."""
    mask = (1 << DISTANCE) - 1
    return spots >> 2 * DISTANCE + 1, spots >> DISTANCE + 1 & mask, spots >> 1 & mask


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def anchors(x: np.ndarray, sizes: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first token, second token, place, most, least) of the suffixes of a block, ``SPAN`` window starts at a time.

    Of equal least hashes in a window the leftmost is its anchor.
    """
    gram = min(GRAM, length)
    ends = np.cumsum(sizes)
    for low in range(0, len(x), SPAN):
        part = x[low : low + SPAN + length - 1]
        if len(part) < length:
            break
        whole = np.zeros(len(part) + 2, dtype=np.int32)
        begin, end = np.clip(ends - sizes - low, 0, len(part)), np.clip(ends - low, 0, len(part))
        long = end - begin >= length
        np.add.at(whole, begin[long], 1)
        np.add.at(whole, end[long] - length + 1, -1)
        start = np.flatnonzero(np.cumsum(whole)[: len(part) - length + 1])
        if not len(start):
            continue
        tool = hashes(len(part) + 1)
        prefixes = tool.prefixes(part)
        grams = mix64((prefixes[gram:] - prefixes[:-gram]) * tool.down[: len(part) - gram + 1])
        least = sliding_least(grams & ~PLACE | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
        place = (least[start] & PLACE).astype(np.int64)
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(start) != 1)) + 1
        a, b, at = start[np.append(0, cut)], start[np.append(cut, len(start)) - 1], place[np.append(0, cut)]
        hull = tool.of(prefixes, a, b + length) ^ mix64(((at - a) << DISTANCE | at - b).astype(np.uint64))
        yield grams[at], hull, at + low, at - a, at - b


def taken_apart(x: np.ndarray, first: np.ndarray, spots: np.ndarray, length: int, step: int) -> tuple[np.ndarray, ...]:
    """The suffixes at ``spots`` in runs of up to ``step`` windows: (first token, second token, place, most, least).

    A core is that of all windows a run could have, so it doesn't depend on where a run is cut off.
    """
    tool = hashes(len(x) + 1)
    prefixes = tool.prefixes(x)
    place, most, least = unspot(spots)
    low, n = least // step, most // step - least // step + 1
    of = np.repeat(np.arange(len(spots)), n)
    run = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
    place, most, least = place[of], np.minimum(run * step + step - 1, most[of]), np.maximum(run * step, least[of])
    core = tool.of(prefixes, place - run * step, place - (run * step + step - 1) + length) ^ mix64(first[of] ^ run.astype(np.uint64))
    hull = tool.of(prefixes, place - most, place - least + length) ^ mix64((most << DISTANCE | least).astype(np.uint64))
    return core, hull, place, most, least


def multikey_sort(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several tokens: by the first, then what is equal there by the next."""
    order = np.argsort(tokens[0], kind="stable")
    for i in range(1, len(tokens)):
        new = np.zeros(len(order), dtype=bool)
        new[:1] = True
        for t in tokens[:i]:
            new[1:] |= t[order][1:] != t[order][:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(order)))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        group = np.repeat(np.arange(len(begin)), size)[tied]
        rows = order[tied]
        order[tied] = rows[np.lexsort((tokens[i][rows], group))]
    return order


def runs(*tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of rows with equal tokens begin, and their sizes."""
    new = np.ones(len(tokens[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([t[1:] != t[:-1] for t in tokens])
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(new)))


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals (start, stop], as few as it takes."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return start[begin], reach[np.append(begin[1:], len(start)) - 1] if len(begin) else reach


def batch(columns: list[np.ndarray], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=[n.split()[0] for n in names.split(", ")])


def within(block: int, first: np.ndarray, second: np.ndarray, place: np.ndarray, most: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    """The block's distinct suffixes (kind 0), and the window starts of those that it has more than once (kind 1, as an interval in the token columns)."""
    order = multikey_sort([first, second])
    begin, size = runs(first[order], second[order])
    one, twice = order[begin], order[np.repeat(size > 1, size)]
    start, stop = merged((place - most)[twice], (place - least)[twice] + 1)
    columns = [np.concatenate([a, b]) for a, b in (
        (first[one].view(np.int64), start),
        (second[one].view(np.int64), stop),
        (np.full(len(one), block), np.full(len(start), block)),
        (spot(place[one], most[one], least[one], (size > 1).astype(np.int64)), np.full(len(start), -1)),
    )]
    return batch(columns, TOKENS)


def stored_blocks(docs: DataFrame, id_column: str) -> DataFrame:
    """(block, ids, known, sizes, text): texts as bytes in blocks of about ``BLOCK``, bucketed by block."""
    spark = docs.sparkSession
    schema = "block long, ids binary, known binary, sizes binary, text binary"
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text_or_empty().alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches):
        task, made, ids, held, n = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            row = [task << 32 | made, np.array([i or 0 for i in ids], dtype=np.int64).tobytes(), bytes(i is not None for i in ids), np.array(list(map(len, held)), dtype=np.int64).tobytes(), zstandard.compress(b"".join(held), 3)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), *[pa.binary()] * 4], strict=True)], names=[f.split()[0] for f in schema.split(", ")])

        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                raw = text.encode()
                if held and n + len(raw) > BLOCK:
                    yield block()
                    made, ids, held, n = made + 1, [], [], 0
                ids.append(doc)
                held.append(raw)
                n += len(raw)
        if held:
            yield block()

    buckets, name = max(spark.sparkContext.defaultParallelism, -(-total // BUCKET_BYTES)), f"plainfit_blocks_{uuid.uuid4().hex}"
    cut = texts.mapInArrow(run, schema).repartition(buckets, "block")
    cut.write.bucketBy(buckets, "block").option("path", shared_path(spark, "blocks")).option("compression", "none").saveAsTable(name)
    return spark.table(name)


def compared(tokens: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Window starts that repeat (block, start, stop), and suffixes to take apart (first, second, block, spot), None after the last step.

    ``tokens`` is a stored table.  Each bucket gives what it can decide, and its first and last run of equal tokens,
    which are compared with those of the other buckets: two rows a bucket.
    """
    size = tokens.count()
    suffixes = tokens.filter("spot >= 0").repartitionByRange(max(1, -(-size // BUCKET_ROWS)), "first", "second", "block")
    schema = f"{TOKENS}, kind int, n long, several boolean"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        held = [[b.column(i).to_numpy() for i in range(4)] for b in batches if b.num_rows]
        if not held:
            return
        first, second, block, spots = (np.concatenate(x) for x in zip(*held, strict=True))
        order = multikey_sort([first, second])
        first, second, block, spots = first[order], second[order], block[order], spots[order]
        begin, size = runs(first, second)
        n = np.add.reduceat(1 + (spots & 1), begin)
        core, variants = runs(first[begin])
        several = np.repeat(variants > 1, variants)  # for each run of equal tokens

        def rows(at, kind, n, several):
            # What is decided needs no tokens any more, and what is taken apart no hull.
            tokens = [first[at] * (kind > 0), second[at] * (kind > 1)]
            return pa.RecordBatch.from_arrays([*map(pa.array, tokens), pa.array(block[at]), pa.array(spots[at]), pa.array(np.full(len(at), kind, np.int32)), pa.array(n), pa.array(several)], names=names)

        for kind, at in enumerate([np.flatnonzero(np.repeat(n > 1, size)), begin[several]]):
            for some in np.array_split(at, -(-len(at) // 100_000) or 1):
                yield rows(some, kind, np.zeros(len(some), np.int64), np.zeros(len(some), bool))
        edge = np.unique([0, len(begin) - 1])
        yield rows(begin[edge], 2, n[edge], several[edge])

    told = materialise(suffixes.mapInArrow(run, schema), "compared")
    by_core, by_both = Window.partitionBy("first"), Window.partitionBy("first", "second")
    edges = told.filter("kind = 2").withColumn("apart", (F.max("several").over(by_core) | (F.min("second").over(by_core) != F.max("second").over(by_core))) & ~F.col("several")).withColumn("n", F.sum("n").over(by_both))
    place, most, least = (F.shiftright("spot", 2 * DISTANCE + 1), *(F.shiftright("spot", k).bitwiseAND((1 << DISTANCE) - 1) for k in (DISTANCE + 1, 1)))
    found = told.filter("kind = 0").select(TOKENS.replace(" long", "").split(", ")).union(edges.filter("n > 1").select(TOKENS.replace(" long", "").split(", ")))
    starts = found.select("block", (place - most).alias("start"), (place - least + 1).alias("stop"))
    starts = starts.union(tokens.filter("spot < 0").select("block", F.col("first").alias("start"), F.col("second").alias("stop")))
    apart = None if last else told.filter("kind = 1").select("first", "block", "spot").union(edges.filter("apart").select("first", "block", "spot"))
    return starts, apart


def splitter(length: int, step: int):
    """Takes the suffixes that a block is asked for apart, into runs of up to ``step`` windows."""

    def split(text: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.Table.from_batches([batch([np.empty(0, np.int64)] * 4, TOKENS)])
        first, spots = np.unique(np.stack([asked.column(c).to_numpy() for c in ("first", "spot")]), axis=1)
        x = np.frombuffer(zstandard.decompress(text.column("text")[0].as_py()), np.uint8)
        return pa.Table.from_batches([within(text.column("block")[0].as_py(), *taken_apart(x, first.view(np.uint64), spots, length, step))])

    return split


def repeats(blocks: DataFrame, length: int) -> DataFrame:
    """(block, start, stop): the window starts [start, stop) whose ``length`` bytes start elsewhere too."""

    def scan(batches):
        for rows in batches:
            for one in rows_of([rows], 1):
                block, sizes, text = (one.column(i)[0].as_py() for i in range(3))
                for found in anchors(np.frombuffer(zstandard.decompress(text), np.uint8), np.frombuffer(sizes, np.int64), length):
                    yield within(block, *found)

    tokens = materialise(blocks.select("block", "sizes", "text").mapInArrow(scan, TOKENS), "suffixes")
    out, apart = compared(tokens, False)
    for step in (STEP, 1):
        parts = blocks.select("block", "text").groupBy("block").cogroup(apart.groupBy("block")).applyInArrow(splitter(length, step), TOKENS)
        more, apart = compared(materialise(parts, "suffixes"), step == 1)
        out = out.union(more)
    return out


def remove_repeats(docs: DataFrame, make, fields: str, length: int = LENGTH, id_column: str = "doc_id") -> DataFrame:
    """(id, ``fields``) of every document: ``make(bytes, covered)`` gives a row from a document's bytes and a mask of those to remove."""
    if not 1 <= length <= MOST_LENGTH:
        raise ValueError(f"a length of 1 to {MOST_LENGTH} bytes is expected")
    blocks = stored_blocks(docs, id_column)
    schema = f"doc_id long, {fields}"

    def cover(rows: pa.Table, starts: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        x = np.frombuffer(zstandard.decompress(row["text"]), np.uint8)
        change = np.zeros(len(x) + 1, dtype=np.int64)
        np.add.at(change, starts.column("start").to_numpy(), 1)
        np.add.at(change, starts.column("stop").to_numpy() - 1 + length, -1)
        covered = np.cumsum(change[:-1]) > 0
        ids, known, ends = np.frombuffer(row["ids"], np.int64).tolist(), row["known"], np.cumsum(np.frombuffer(row["sizes"], np.int64)).tolist()
        made, at = [], 0
        for i, here, end in zip(ids, known, ends, strict=True):
            made.append((i if here else None, *make(x[at:end], covered[at:end])))
            at = end
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.table(list(map(list, zip(*made, strict=True))), names=names)

    found = repeats(blocks, length)
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cover, schema)


def kept(x: np.ndarray, covered: np.ndarray) -> tuple[int, int, int, str]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of a document."""
    removed = int(np.count_nonzero(covered))
    spans = int(np.count_nonzero(covered[1:] & ~covered[:-1]) + covered[:1].sum()) if removed else 0
    return len(x), removed, spans, hashlib.sha256(x[~covered].tobytes() if removed else x.tobytes()).hexdigest()
