"""Running totals in the order of columns, ranks and exact quantiles, for tables of any size: no window runs over all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialise


def running(df: DataFrame, order: str | Sequence[str], value: str, out: str, kind: str = "sum", by: Sequence[str] = ()) -> DataFrame:
    """``df``, whose ``by`` and ``order`` are distinct, with ``out``: the sum (0 for the first) or max (null) of ``value`` over the rows of the group before.

    The rows are sorted by ranges of (by, order) once and stored with the running total of their group in their range;
    what the ranges before hold of a group is at most one row for each range, which is broadcast.  So a group may go
    over any number of tasks.  Sums keep the type of ``value`` (long or double), maxima are doubles.
    """
    order, by = [order] if isinstance(order, str) else list(order), list(by)
    at, whole = df.columns.index(value), kind == "sum" and not isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType))
    places = [df.columns.index(c) for c in by]
    schema = T.StructType([*df.schema, T.StructField("__range", T.IntegerType()), T.StructField("__own", T.LongType() if whole else T.DoubleType())])

    def within(v, held):
        if kind == "sum":
            after = held + np.cumsum(v)
            return after, after - v
        after = np.maximum.accumulate(np.concatenate([[held], v]))
        return after[1:], after[:-1]

    def scan(batches):
        part, none = TaskContext.get().partitionId(), 0 if kind == "sum" else -np.inf
        held, last = none, None
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64 if whole else np.float64)
            new = np.zeros(len(v), dtype=bool)
            for c in places:
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(c)[0].as_py() for c in places)
            cuts = [0, *np.flatnonzero(new).tolist(), len(v)]
            held = held if first == last else none
            own = np.empty(len(v), dtype=v.dtype)
            for i, j in pairwise(cuts):
                after, own[i:j] = within(v[i:j], held if i == 0 else none)
                held = after[-1]
            last = tuple(batch.column(c)[len(v) - 1].as_py() for c in places)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(own, mask=np.isneginf(own) if kind == "max" else None)], names=schema.names)

    ranged = materialise(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).mapInArrow(scan, schema), "running")
    agg, keys = {"sum": F.sum, "max": F.max}[kind], [f"__of{i}" for i in range(len(by))]
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of a group
    totals = ranged.groupBy("__range", *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True))).agg(agg(value).alias("__total"))
    # A range begins with at most one group that the range before ends with.
    base = totals.select(F.col("__range").alias("__from"), *keys, agg("__total").over(before).alias("__base")).filter("__base is not null")
    same = F.col("__range") == F.col("__from")
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    both = F.greatest("__own", F.col("__base").cast("double")) if kind == "max" else F.col("__own") + F.coalesce("__base", F.lit(0))
    return ranged.join(F.broadcast(base), same, "left").withColumn(out, both).drop("__range", "__own", "__base", "__from", *keys)


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, count, rank) of the distinct values that aren't null, ties with their mean rank."""
    by = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("count"))
    return running(by, value, "count", "__below").select(value, "count", (F.col("__below") + (F.col("count") + 1) / 2).alias("rank"))


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., q0, q1, ...): linearly interpolated quantiles of the values that aren't null or NaN, in each group.

    Counts of distinct values are sorted by ranges of (group, value) and stored.  The totals of each range's groups, of
    which there are no more than groups and ranges together, tell which ranges hold a wanted rank, and only those are
    read again.  No task holds the values of a group, however large it is.
    """
    by = list(by)
    known = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    keys = [f"__g{i}" for i in range(len(by))]
    counts = known.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(col).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    schema = T.StructType([*counts.schema, T.StructField("__range", T.IntegerType())])

    def numbered(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32))], names=schema.names)

    ranged = materialise(counts.repartitionByRange(*keys, "__v").mapInArrow(numbered, schema), "quantiles")
    group = Window.partitionBy(*keys)
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "__range").agg(F.sum("__c").alias("__t")).withColumns({"__n": F.sum("__t").over(group), "__before": F.coalesce(F.sum("__t").over(before), F.lit(0))})
    place = [(F.col("__n") - 1) * float(q) for q in qs]

    def holds(first: Column, size: Column, at: Column) -> Column:
        return (first <= at) & (at < first + size)

    def wanted(first: Column, size: Column) -> Column:
        some = F.lit(False)
        for p in place:
            some = some | holds(first, size, F.floor(p)) | holds(first, size, F.ceil(p))
        return some

    few = totals.filter(wanted(F.col("__before"), F.col("__t"))).select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("__range").alias("__range_"), "__n", "__before")
    same = F.col("__range") == F.col("__range_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    inner = Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    read = ranged.join(few, same).withColumn("__below", F.col("__before") + F.coalesce(F.sum("__c").over(inner), F.lit(0)))
    read, out = read.filter(wanted(F.col("__below"), F.col("__c"))), []
    for i, p in enumerate(place):
        low, high = (F.max(F.when(holds(F.col("__below"), F.col("__c"), at), F.col("__v"))) for at in (F.floor(p), F.ceil(p)))
        out.append((low + (high - low) * F.max(p - F.floor(p))).alias(f"q{i}"))
    found = read.groupBy(*keys).agg(*out)
    return found.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *(f"q{i}" for i in range(len(qs))))
