"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

``token_pieces`` cuts every document's ids into pieces of at most ``capacity`` tokens; ``pack`` gives each piece a
sequence and a place in it.  Sizes are whole numbers up to ``capacity``, so what has to be solved is only the table
"how many pieces of each size" (at most ``capacity`` rows, whatever the input), and the answer is a list of patterns
with multiplicities.  The pieces themselves stay distributed: each gets its rank among those of its size (task-local
ranks plus a running sum over tasks), and ranks are dealt to the patterns' slots.

Null and empty texts have one piece, their end id.  Equal rows each get a place of their own.  Further columns of the
input are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, rows_of, text_or_empty
from .tokens import ByteBpe, load_once, ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id") -> DataFrame:
    """One row per piece: its document, number, start, length, the ids' checksum, and its rank among the task's pieces of that length.

    A document longer than ``capacity`` is cut so that all pieces but the first are full.
    """
    raw = ship(docs.sparkSession, tokenizer_path)

    def run(batches):
        model, task, seen = load_once(ByteBpe, raw.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in rows_of(batches, 2000):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(model.encode(text), [end_id]).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, begin in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[begin : begin + capacity] if piece else ids[:first]
                    out.append((doc, piece, begin, len(part), zlib.crc32(part), task, int(seen[len(part)])))
                    seen[len(part)] += 1
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, PIECES)


def dominance(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns that some best packing holds, taken out of ``counts`` (pieces by size) until none is provable.

    A set with piece ``w`` dominates the others with ``w`` if each of those can be exchanged against it, item by
    item or sums of items against a larger item.  Sets of up to three pieces are tried:
    a full one; ``w`` and its exact rest; ``w`` alone if nothing fits beside; ``w`` and the largest that fits, if two
    never fit or no two are larger together; ``w``, that one and the largest third, if three never fit beside ``w``
    and no feasible pair has a larger second piece.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        fixed.append((pattern, times))
        for size in pattern:
            counts[size] -= times

    def times(pattern: tuple[int, ...]) -> int:
        return min(int(counts[s]) // pattern.count(s) for s in pattern)

    if counts[capacity]:
        take((capacity,), int(counts[capacity]))
    changed = True
    while changed:
        changed = False
        for w in range(capacity - 1, 0, -1):
            while counts[w]:
                room, pattern = capacity - w, None
                counts[w] -= 1
                have = np.flatnonzero(counts)
                small = np.repeat(have[:3], np.minimum(counts[have[:3]], 3))[:3]
                fit = have[have <= room]
                if not len(fit):
                    pattern = (w,)
                elif fit[-1] == room or len(small) < 2 or small[:2].sum() > room:
                    pattern = (w, int(fit[-1]))
                elif len(small) < 3 or small.sum() > room:
                    a = int(fit[-1])
                    # the best partner of every size that fits, the same size only if there are two
                    partner = fit[np.maximum(np.searchsorted(fit, room - fit, side="right") - 1, 0)]
                    ok = (fit + partner <= room) & ((fit != partner) | (counts[fit] > 1))
                    best = int((fit + partner)[ok].max(initial=0))
                    second = int(np.minimum(fit, partner)[ok].max(initial=0))
                    if a >= best and not ((fit == partner) & ~ok & (2 * fit <= room)).any():
                        pattern = (w, a)
                    elif second and a + second <= room and (a != second or counts[a] > 1):
                        pattern = (w, a, second)
                counts[w] += 1
                if pattern is None:
                    break
                take(pattern, max(1, times(pattern)))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on sizes with multiplicities: bins of one content are held as one group."""
    open_: dict[int, list[list]] = {}
    for size in range(capacity, 0, -1):
        n = int(counts[size])
        counts[size] = 0
        fresh: dict[int, list[list]] = {}
        while n:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                per = capacity // size
                for k, many in ((per, n // per), (n % per, 1)):
                    if k and many:
                        fresh.setdefault(capacity - k * size, []).append([(size,) * k, many])
                break
            content, many = group = open_[room][-1]
            m = min(n, many)
            n -= m
            if m == many:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
            else:
                group[1] -= m
            open_.setdefault(room - size, []).append([(*content, size), m])
        for r, groups in fresh.items():
            open_.setdefault(r, []).extend(groups)
    return [(tuple(c), m) for groups in open_.values() for c, m in groups]


def slots(sizes: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (size, first rank, last rank + 1, first sequence, offset): which ranks of a size go where."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in sizes.items():
        counts[size] = n
    patterns = dominance(counts, capacity)
    patterns += best_fit(counts, capacity)
    rank, sequence, rows = np.zeros(capacity + 1, dtype=np.int64), 0, []
    for pattern, many in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, rank[size], rank[size] + many, sequence, offset))
            rank[size] += many
            offset += size
        sequence += many
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of a stored table of ``token_pieces``."""
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(slots(sizes, capacity))  # bounded by the capacity, not the input
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base")), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))

    def place(batches):
        table = plan.value
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            begin, stop = np.searchsorted(table[:, 0], size), np.searchsorted(table[:, 0], size, side="right")
            step = np.full(len(size), 0)
            while len(todo := np.flatnonzero(stop - begin > 1)):  # halves the slots of the size until one is left
                mid = (begin[todo] + stop[todo]) // 2
                right = table[mid, 1] <= rank[todo]
                begin[todo[right]], stop[todo[~right]] = mid[right], mid[~right]
            slot = table[begin] if len(size) else np.empty((0, 5), dtype=np.int64)
            out = [*batch.columns[:5], pa.array(slot[:, 3] + rank - slot[:, 1] + step), pa.array(slot[:, 4])]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id") -> DataFrame:
    """``token_pieces``, stored once, then ``pack``."""
    return pack(materialise(token_pieces(docs, tokenizer_path, capacity, end_id, id_column), "pieces"), capacity)
