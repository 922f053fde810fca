"""Aggregates, windows and rankings of fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import row_mean
from ..plans.order import exact_quantiles, running
from ..sources.scratch import materialise


def rmse(df: DataFrame, keys: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col(pred), 2))).alias("rmse"))


def mean_if_complete(perf: DataFrame, value: str = "rank", out: str = "mean_rank") -> DataFrame:
    """Per model the mean of ``value`` if it has an rmse on every dataset, else null."""
    n = perf.select(F.count_distinct("dataset").alias("__n"))
    by = perf.groupBy("model").agg(F.count_distinct(F.when(F.col("rmse").isNotNull(), F.col("dataset"))).alias("__k"), F.avg(value).alias(out))
    return by.crossJoin(F.broadcast(n)).select("model", F.when(F.col("__k") == F.col("__n"), F.col(out)).alias(out))  # one row is broadcast


def pass_rate(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"))


def category_scores(facts: DataFrame, categories: list[str], keys: list[str]) -> DataFrame:
    return facts.groupBy(*keys).pivot("category", categories).agg(F.avg(F.col("passed").cast("double")))


def mean_se(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    n = F.count(value)
    se = F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).otherwise(0.0)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), se.alias("se"), n.alias("n"))


def mean_se_two_stage(df: DataFrame, keys: list[str], unit: list[str], values: list[str]) -> DataFrame:
    """Mean and standard error over units of the units' means of the row means of ``values``."""
    first = df.withColumn("__v", row_mean(*(F.col(v).cast("double") for v in values))).groupBy(*keys, *unit).agg(F.avg("__v").alias("__v"))
    return mean_se(first, keys, "__v")


def collapse(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each key, with the means of ``values`` over those that aren't null."""
    return df.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


def suite_counts(facts: DataFrame, suites: list[str], by: list[str], otherwise: str = "standard") -> DataFrame:
    """Passed and all tests of each suite; without a column ``suite`` it is the part of the test's name before the first underscore, if that is one of ``suites``."""
    if "suite" not in facts.columns:
        prefix = F.substring_index("test", "_", 1)
        facts = facts.withColumn("suite", F.when(prefix.isin(suites), prefix).otherwise(otherwise))
    names = [otherwise, *(s for s in suites if s != otherwise)]
    of = lambda s: F.col("suite") == s
    return facts.groupBy(*by).agg(*(c for s in names for c in (F.count_if(of(s) & F.col("passed")).alias(f"{s}_passed"), F.count_if(of(s)).alias(f"{s}_tests"))))


def shape_stats(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, skewness, kurtosis): third and fourth standardised moments, the latter less 3."""
    stats = F.array(*(F.struct(F.lit(c).alias("column"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis")) for c in cols))
    return df.groupBy(*(by or [])).agg(stats.alias("__s")).select(*(by or []), F.inline("__s"))


def pivot_mean(df: DataFrame, index: list[str], col: str, levels: list, value: str) -> DataFrame:
    """Means of ``value`` with a column for each of ``levels``."""
    return df.groupBy(*index).pivot(col, levels).agg(F.avg(value))


def describe(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum, in each group."""
    by = by or []
    stats = df.groupBy(*by).agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    quarters = exact_quantiles(df, col, [0.25, 0.5, 0.75], by).withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75", **{k: f"__{k}" for k in by}})
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return stats.join(quarters, same, "left").select(*by, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Counts and shares of values, the largest first; ``k`` keeps a top list."""
    total = df.agg(F.count(col).alias("__t"))
    out = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))  # one row
    out = out.select(col, "n", (F.col("n") / F.col("__t")).alias("share")).orderBy(F.desc("n"), col)
    return out.limit(k) if k else out


def crosstab(df: DataFrame, a: str, b: str, levels: list) -> DataFrame:
    return df.groupBy(a).pivot(b, levels).agg(F.count(F.lit(1))).na.fill(0)


def missing_counts(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins from the minimum to the maximum, which is in the last."""
    edge = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    width = (edge.hi - edge.lo) / bins if edge.lo is not None and edge.hi > edge.lo else 1.0
    bin_ = F.least(F.floor((F.col(col) - float(edge.lo or 0)) / width), F.lit(bins - 1))
    return df.filter(F.col(col).isNotNull()).groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ntile_label(df: DataFrame, col: str, key: list[str], labels: list, out: str = "label") -> DataFrame:
    """Labels of equal parts of the rows in order of ``col`` and then ``key``; the first parts take what doesn't divide, nulls have none."""
    known = df.filter(F.col(col).isNotNull())
    size, more = divmod(known.count(), len(labels))
    ranked = running(known.withColumn("__one", F.lit(1)), [col, *key], "__one", "__at")
    at = F.col("__at")
    part = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / max(size, 1)))
    labelled = ranked.withColumn(out, F.element_at(F.array(*map(F.lit, labels)), (part + 1).cast("int"))).drop("__one", "__at")
    return labelled.unionByName(df.filter(F.col(col).isNull()).withColumn(out, F.lit(None).cast(labelled.schema[out].dataType)))


def rank_models(perf: DataFrame, order: str = "model") -> DataFrame:
    """Ranks within a dataset by rmse, ties by ``order``; rows without rmse have none."""
    w = Window.partitionBy("dataset").orderBy(F.col("rmse").asc_nulls_last(), order)
    return perf.withColumn("rank", F.when(F.col("rmse").isNotNull(), F.row_number().over(w)))


def avg_rank(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks in which ties share their mean; nulls have none.

    Ranks come from running counts of the distinct values of each group and are joined with the rows, so that a group
    may be of any size.  The rows are stored first, so that both sides of the join hold the same numbers to the last
    bit: a sum worked out twice may add its parts in another order.
    """
    df = materialise(df.drop(out), "ranked")
    keys = [f"__k{i}" for i in range(len(by))]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    below = running(counts, "__v", "__c", "__below", by=keys)
    ranks = below.select(*keys, "__v", (F.col("__below") + (F.col("__c") + 1) / 2).alias(out))
    same = F.col(value) == F.col("__v")
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return df.join(ranks, same, "left").drop(*keys, "__v")


def pareto(df: DataFrame, lo: str, hi: str, by: list[str] | None = None) -> DataFrame:
    """Rows that no row with a smaller-or-equal ``lo`` reaches in ``hi``, one of equal ones by the sort order.

    Rows are first thinned to the best ``hi`` of each distinct ``lo`` of a group, which a partial aggregate does, and
    the running maximum of those goes range by range, with groups or without.
    """
    by = by or []
    best = df.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull()).groupBy(*by, lo).agg(F.max(hi).alias(hi))
    best = running(best, lo, hi, "__b", "max", by)
    return best.filter(F.col("__b").isNull() | (F.col(hi) > F.col("__b"))).drop("__b")


def non_dominated(cands: DataFrame, refs: DataFrame, lo: str, hi: str) -> DataFrame:
    """Candidates that no reference dominates (lower-or-equal ``lo`` and higher-or-equal ``hi``, one of them strictly).

    All there is to know about the references at a value of ``lo`` is their best ``hi`` there and below it, which runs
    by ranges over the distinct values; candidates with a null stay.
    """
    lowest = F.lit(float("-inf"))
    known = refs.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(F.col(lo).cast("double").alias("__l"), F.col(hi).cast("double").alias("__h"))
    places = known.unionByName(cands.filter(F.col(lo).isNotNull()).select(F.col(lo).cast("double").alias("__l"), lowest.alias("__h"))).groupBy("__l").agg(F.max("__h").alias("__h"))
    best = running(places, "__l", "__h", "__below", "max").select("__l", "__h", F.coalesce("__below", lowest).alias("__below"))
    joined = cands.withColumn("__at", F.col(lo).cast("double")).join(best, F.col("__at") == F.col("__l"), "left")
    own = F.col(hi).cast("double")
    beaten = (F.col("__below") >= own) | (F.col("__h") > own)
    return joined.filter(~F.coalesce(beaten, F.lit(False))).select(*(F.col(f"`{c}`") for c in cands.columns))


def dedup(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_by_size(df: DataFrame, value: str, k: int, key: str) -> DataFrame:
    """The ``k`` rows of the largest sizes of ``value``, ties by ``key``."""
    return df.orderBy(F.abs(value).desc_nulls_last(), key).limit(k)


def mass_select(terms: DataFrame, value: str, mass: float = 0.96, least: int = 1) -> DataFrame:
    """The largest terms by size until they hold ``mass`` of the total (terms: as many rows as a model has)."""
    size, w = F.abs(F.col(value)), Window.orderBy(F.desc(F.abs(F.col(value))))
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(size).over(Window.partitionBy())
    return terms.withColumn("__b", before / total).withColumn("__r", F.row_number().over(w)).filter(f"__b < {mass} or __r <= {least}").drop("__b", "__r")


def best_split(hist: DataFrame, min_leaf: int) -> DataFrame:
    """Per feature the bin after which a split gains most: (bin, n, s) are the counts and label sums of ordered bins."""
    w = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("feature")
    h = hist.select("feature", "bin", F.sum("n").over(w).alias("nl"), F.sum("s").over(w).alias("sl"), F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"))
    gain = F.pow("sl", 2) / F.col("nl") + F.pow(F.col("s") - F.col("sl"), 2) / (F.col("n") - F.col("nl")) - F.pow("s", 2) / F.col("n")
    ok = (F.col("nl") >= min_leaf) & (F.col("n") - F.col("nl") >= min_leaf)
    return h.filter(ok).withColumn("gain", gain).groupBy("feature").agg(F.max_by("bin", F.struct("gain", -F.col("bin"))).alias("bin"), F.max("gain").alias("gain"))


def smooth(shape: DataFrame, passes: int = 3, middle: float = 0.6) -> DataFrame:
    """(feature, bin, value): each pass replaces inner values by a weighted mean with their neighbours; the ends stay."""
    w, side = Window.partitionBy("feature").orderBy("bin"), (1 - middle) / 2
    for _ in range(passes):
        a, b = F.lag("value").over(w), F.lead("value").over(w)
        shape = shape.withColumn("value", F.when(a.isNull() | b.isNull(), F.col("value")).otherwise(side * a + middle * F.col("value") + side * b))
    return shape


#: Weights of the five-point Gaussian kernel from the middle outwards.
FIVE = (6.0, 4.0, 1.0)


def smooth_five(shape: DataFrame, passes: int = 1, weights: tuple[float, float, float] = FIVE) -> DataFrame:
    """(feature, bin, value): means with two neighbours on each side; at the ends, of those that are there."""
    w = Window.partitionBy("feature").orderBy("bin")
    for _ in range(passes):
        near = [(F.col("value"), weights[0])] + [(f("value", k).over(w), weights[k]) for k in (1, 2) for f in (F.lag, F.lead)]
        total = sum((F.when(v.isNotNull(), F.lit(x)).otherwise(0.0) for v, x in near), F.lit(0.0))
        shape = shape.withColumn("value", sum((F.coalesce(v, F.lit(0.0)) * x for v, x in near), F.lit(0.0)) / total)
    return shape
