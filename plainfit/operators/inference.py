"""Tests and effect sizes from grouped moments and ranks; p-values are functions of the aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..plans.gram import MOST_GROUPS, Moments, gram
from ..plans.order import running
from .linear import ols


@dataclass(frozen=True)
class Test:
    statistic: float
    df: float
    p: float


#: Two-sided, or that the first is ``greater`` or ``less``.
SIDES = ("two-sided", "greater", "less")


def group_moments(df: DataFrame, value: str, group: str, groups: list | None = None) -> dict:
    """{group: (n, mean, variance)} of the named groups, or of all of a column that is known to have few values."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    if groups is not None:
        rows = rows.filter(F.col(group).isin(*groups))
    found = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: name those that are wanted")
    return {r[group]: (r.n, r.m, r.v or 0.0) for r in found}


def _tail(t: float, two_sided: float, side: str) -> float:
    """The p-value of a symmetric statistic for one of ``SIDES``."""
    if side not in SIDES:
        raise ValueError(f"one of {SIDES} is expected")
    if side == "two-sided":
        return min(1.0, two_sided)
    return two_sided / 2 if (t > 0) == (side == "greater") else 1 - two_sided / 2


def ttest_ind(df: DataFrame | None, value: str, group: str, a, b, equal_var: bool = True, side: str = "two-sided", moments: dict | None = None) -> Test:
    """``moments`` (of ``group_moments``) saves reading the rows again where several tests are made."""
    m = moments or group_moments(df, value, group, [a, b])
    (n1, m1, v1), (n2, m2, v2) = m[a], m[b]
    if equal_var:
        d = n1 + n2 - 2
        se = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / d * (1 / n1 + 1 / n2))
    else:
        e1, e2 = v1 / n1, v2 / n2
        d, se = (e1 + e2) ** 2 / (e1**2 / (n1 - 1) + e2**2 / (n2 - 1)), math.sqrt(e1 + e2)
    t = (m1 - m2) / se
    return Test(t, d, _tail(t, dist.t_sf2(t, d), side))


def ttest_1samp(df: DataFrame, value: Column, mean: float = 0.0, side: str = "two-sided") -> Test:
    """One sample, or pairs by their difference."""
    r = df.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).first()
    t = (r.m - mean) / (r.s / math.sqrt(r.n))
    return Test(t, r.n - 1, _tail(t, dist.t_sf2(t, r.n - 1), side))


def paired(df: DataFrame, entity: str, condition: str, value: str, a, b) -> DataFrame:
    """(entity, a, b, d): each entity's means under two conditions and their difference; entities without both are left out."""
    of = lambda level: F.avg(F.when(F.col(condition) == level, F.col(value)))
    means = df.filter(F.col(condition).isin(a, b)).groupBy(F.col(entity).alias("entity")).agg(of(a).alias("a"), of(b).alias("b"))
    return means.withColumn("d", F.col("a") - F.col("b")).filter("d is not null")


def ttest_rel(df: DataFrame, entity: str, condition: str, value: str, a, b, side: str = "two-sided") -> Test:
    """Paired t-test on the entities' means."""
    return ttest_1samp(paired(df, entity, condition, value, a, b), F.col("d"), 0.0, side)


#: Without ties, the null distribution is counted where one sample of a rank-sum test has at most ``EXACT_SUM`` values or
#: a signed-rank test at most ``EXACT_SIGNED`` pairs (fixed values); beyond, and with ties, it is taken as normal.
EXACT_SUM, EXACT_SIGNED = 8, 50


def rank_sum_null(a: int, b: int) -> np.ndarray:
    """The chance of each U from 0 to ``a * b`` for samples of ``a`` and ``b`` values without ties.

    The counts are the coefficients of the Gaussian binomial, a product of (1 - q^(b + i)) / (1 - q^i): each factor
    takes off a shifted copy and adds up in steps of i.  The lower half is enough, the upper mirrors it.
    """
    a, b = min(a, b), max(a, b)
    half = a * b // 2 + 1
    counts = np.zeros(half)
    counts[0] = 1.0
    for i in range(1, a + 1):
        if b + i < half:
            counts[b + i :] -= counts[: half - b - i].copy()
        for start in range(min(i, half)):
            counts[start::i] = np.cumsum(counts[start::i])
        counts *= i / (b + i)  # chances in place of counts that grow out of range
    whole = np.empty(a * b + 1)
    whole[:half], whole[a * b + 1 - half :] = counts, counts[::-1]
    return whole


def signed_rank_null(n: int) -> np.ndarray:
    """The chance of each sum of positive ranks from 0 to n (n + 1) / 2 without ties."""
    chance = np.ones(1)
    for i in range(1, n + 1):
        chance = (np.append(chance, np.zeros(i)) + np.append(np.zeros(i), chance)) / 2
    return chance


def _counted(chances: np.ndarray, value: float, side: str) -> float:
    """The exact p-value of a symmetric statistic."""
    at = round(value)
    above, below = float(chances[at:].sum()), float(chances[: at + 1].sum())
    return min(1.0, {"greater": above, "less": below, "two-sided": 2 * min(above, below)}[side])


def mann_whitney(df: DataFrame, value: str, group: str, a, b, side: str = "two-sided", method: str = "auto") -> Test:
    """U of group ``a``: counted (``exact``) or normal with average ranks, tie and continuity corrections.

    ``auto`` counts where there are no ties and one sample is small.  Ranks come from the running count over distinct
    values, so equal values are never gathered in a task.
    """
    _tail(0.0, 1.0, side)
    both = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull())
    by = both.groupBy(value).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(group) == a).alias("ca"))
    r = running(by, value, "c", "below").withColumn("rank", F.col("below") + (F.col("c") + 1) / 2).agg(F.sum(F.col("rank") * F.col("ca")).alias("r"), F.sum("c").alias("n"), F.sum("ca").alias("na"), F.sum(F.pow("c", 3) - F.col("c")).alias("ties")).first()
    na, nb = r.na, r.n - r.na
    u = r.r - na * (na + 1) / 2
    if method == "exact" or method == "auto" and not r.ties and min(na, nb) <= EXACT_SUM:
        return Test(u, r.n, _counted(rank_sum_null(na, nb), u, side))
    sd = math.sqrt(na * nb / 12 * (r.n + 1 - r.ties / (r.n * (r.n - 1))))
    gap = u - na * nb / 2
    if side == "two-sided":
        return Test(u, r.n, min(1.0, 2 * dist.normal_sf((abs(gap) - 0.5) / sd)))
    return Test(u, r.n, dist.normal_sf(((gap if side == "greater" else -gap) - 0.5) / sd))


def wilcoxon(df: DataFrame, difference: Column, side: str = "two-sided", method: str = "auto") -> Test:
    """Sum of the ranks of positive differences (zeros left out): counted, or normal with tie correction.

    ``auto`` counts where there are few differences, none of them zero or as large as another.
    """
    _tail(0.0, 1.0, side)
    known = df.select(difference.alias("d")).filter("d is not null")
    by = known.groupBy(F.abs("d").alias("v")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("cp"))
    zero = F.col("v") == 0
    by = by.select("v", F.when(zero, 0).otherwise(F.col("c")).alias("c"), "cp", F.when(zero, F.col("c")).otherwise(0).alias("zeros"))
    ranked = running(by, "v", "c", "below").withColumn("rank", F.col("below") + (F.col("c") + 1) / 2)
    r = ranked.agg(F.sum(F.col("rank") * F.col("cp")).alias("w"), F.sum("c").alias("n"), F.sum(F.pow("c", 3) - F.col("c")).alias("ties"), F.sum("zeros").alias("zeros")).first()
    if method == "exact" or method == "auto" and not r.ties and not r.zeros and r.n <= EXACT_SIGNED:
        return Test(r.w, r.n, _counted(signed_rank_null(r.n), r.w, side))
    sd = math.sqrt(r.n * (r.n + 1) * (2 * r.n + 1) / 24 - r.ties / 48)
    z = (r.w - r.n * (r.n + 1) / 4) / sd
    return Test(r.w, r.n, _tail(z, 2 * dist.normal_sf(abs(z)), side))


def chi2_contingency(df: DataFrame, a: str, b: str, correction: bool = True) -> Test:
    """Independence of two columns; 2x2 tables are Yates-corrected unless told otherwise.

    Cells and margins stay distributed: the statistic is n (sum of cell^2 / (row * column) - 1), so empty cells need no row.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = (cells.groupBy(k).agg(F.sum("n").alias(f"n{k}")) for k in "ab")
    joined = cells.join(rows, "a").join(cols, "b")
    r = joined.agg(F.sum(F.col("n") / F.col("na") * F.col("n") / F.col("nb")).alias("x"), F.sum("n").alias("n"), F.count_distinct("a").alias("ra"), F.count_distinct("b").alias("rb")).first()
    x, d = r.n * (r.x - 1), (r.ra - 1) * (r.rb - 1)
    if d == 1 and correction:  # four cells at most
        table = np.zeros((2, 2))
        found = cells.collect()
        ka, kb = sorted({c.a for c in found}), sorted({c.b for c in found})
        for c in found:
            table[ka.index(c.a), kb.index(c.b)] = c.n
        expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
        gap = np.abs(table - expected)
        x = float(((gap - np.minimum(0.5, gap)) ** 2 / expected).sum())
    return Test(float(x), d, dist.chi2_sf(x, d))


def anova_oneway(df: DataFrame | None, value: str, group: str, moments: dict | None = None) -> Test:
    """F of the groups' means; the groups' moments are summed up in Spark, however many there are, or given (by ``group_moments``)."""
    if moments is not None:
        n, k = sum(m[0] for m in moments.values()), len(moments)
        middle = sum(m[0] * m[1] for m in moments.values()) / n
        within = sum((m[0] - 1) * m[2] for m in moments.values())
        f = sum(m[0] * (m[1] - middle) ** 2 for m in moments.values()) / (k - 1) / (within / (n - k))
        return Test(f, n - k, dist.f_sf(f, k - 1, n - k))
    by = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    r = by.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum((F.col("n") - 1) * F.col("v")).alias("within")).first()
    between = by.agg(F.sum(F.col("n") * F.pow(F.col("m") - r.s / r.n, 2)).alias("b")).first().b
    f = between / (r.k - 1) / (r.within / (r.n - r.k))
    return Test(f, r.n - r.k, dist.f_sf(f, r.k - 1, r.n - r.k))


def anova_lm(m: Moments, terms: dict[str, list[str]]) -> list[tuple[str, int, float, float, float]]:
    """Type II table (term, df, sum of squares, F, p) of a linear model, all submodels solved from one moment job.

    ``terms`` names each term's columns of ``m``; a term's sum of squares is what it adds to all terms that don't
    contain it, and ``a:b`` contains ``a`` and ``b``.
    """
    place = {n: i for i, n in enumerate(m.names)}
    holds = lambda big, small: set(small.split(":")) < set(big.split(":"))

    def fit(names: list[str]) -> tuple[float, int]:
        keep = [place[c] for t in names for c in terms[t]]
        e = ols(m, keep)
        _, s, _, _, _ = m.centered()
        return m.sse(e.coef, e.intercept), int(np.linalg.matrix_rank(s[np.ix_(keep, keep)])) if keep else 0

    whole, rank = fit(list(terms))
    d, out = m.rows - rank - 1, []
    for t in terms:
        rest = [o for o in terms if o != t and not holds(o, t)]
        (with_, r1), (without, r0) = fit([*rest, t]), fit(rest)
        ss, k = without - with_, r1 - r0
        f = ss / max(k, 1) / (whole / d)
        out.append((t, k, ss, f, dist.f_sf(f, k, d)))
    return [*out, ("residual", int(d), whole, None, None)]


def pearson(df: DataFrame, x: str, y: str) -> Test:
    r = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n")).first()
    t = r.r * math.sqrt((r.n - 2) / max(1e-300, 1 - r.r**2))
    return Test(r.r, r.n - 2, dist.t_sf2(t, r.n - 2))


def spearman(df: DataFrame, x: str, y: str) -> Test:
    """Correlation of average ranks, from the counts of the distinct pairs of values; one job ranks both columns."""
    known = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    pairs = known.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    both = F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col(c).alias("v")) for i, c in enumerate("xy"))))
    counts = pairs.select("c", both.alias("e")).groupBy("e.which", "e.v").agg(F.sum("c").alias("c"))
    ranks = running(counts, "v", "c", "below", by=["which"]).withColumn("rank", F.col("below") + (F.col("c") + 1) / 2)
    for i, c in enumerate("xy"):
        pairs = pairs.join(ranks.filter(F.col("which") == i).select(F.col("v").alias(c), F.col("rank").alias(f"r{c}")), c)
    m = gram(pairs, {"x": F.col("rx")}, F.col("ry"), weight=F.col("c"))[()]
    _, s, c, yy, _ = m.centered()
    r = float(c[0] / math.sqrt(s[0, 0] * yy))
    t = r * math.sqrt((m.n - 2) / max(1e-300, 1 - r**2))
    return Test(r, m.n - 2, dist.t_sf2(t, m.n - 2))


def partial_corr(df: DataFrame, x: str, y: str, controls: list[str]) -> float:
    """Correlation of two columns given others, from the inverse of the moments."""
    m = gram(df, {c: F.col(c) for c in [x, *controls]}, F.col(y))[()]
    s = np.zeros((len(controls) + 2,) * 2)
    mean = m.matrix[0, 1:] / m.n
    s = np.linalg.inv(m.matrix[1:, 1:] - m.n * np.outer(mean, mean))
    return float(-s[0, -1] / math.sqrt(s[0, 0] * s[-1, -1]))


def prop_ztest(df: DataFrame, success: str, group: str, a, b, side: str = "two-sided") -> Test:
    m = group_moments(df, success, group, [a, b])
    (n1, p1, _), (n2, p2, _) = m[a], m[b]
    p = (n1 * p1 + n2 * p2) / (n1 + n2)
    z = (p1 - p2) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return Test(z, n1 + n2, _tail(z, 2 * dist.normal_sf(abs(z)), side))


def cohens_d(df: DataFrame | None, value: str, group: str, a, b, moments: dict | None = None) -> float:
    m = moments or group_moments(df, value, group, [a, b])
    return (m[a][1] - m[b][1]) / math.sqrt((m[a][2] + m[b][2]) / 2)


def cohens_dz(df: DataFrame, entity: str, condition: str, value: str, a, b) -> float:
    """The mean of the entities' differences in their own deviations."""
    r = paired(df, entity, condition, value, a, b).agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s")).first()
    return r.m / r.s


def cohens_h(p1: float, p2: float) -> float:
    return 2 * math.asin(math.sqrt(p1)) - 2 * math.asin(math.sqrt(p2))


#: A factor may have so many levels in a design.
MOST_LEVELS = 1000


def design(df: DataFrame, numeric: list[str], factors: dict[str, object] | list[str] = (), interactions: list[tuple[str, str]] = ()) -> tuple[dict[str, Column], dict[str, list[str]]]:
    """Columns of a linear model and the columns of each term.

    Factors become indicators of all levels but the reference (the one given, or the first in order); interactions are
    products of the columns of two terms.
    """
    cols, terms = {n: F.col(n).cast("double") for n in numeric}, {n: [n] for n in numeric}
    for name in factors:
        levels = sorted(r[0] for r in df.select(name).na.drop().distinct().limit(MOST_LEVELS + 1).collect())
        if len(levels) > MOST_LEVELS:
            raise ValueError(f"{name} has more than {MOST_LEVELS} levels")
        ref = factors[name] if isinstance(factors, dict) and factors[name] is not None else levels[0] if levels else None
        own = {f"{name}[{v}]": F.when(F.col(name).isNotNull(), (F.col(name) == v).cast("double")) for v in levels if v != ref}
        cols, terms = cols | own, terms | {name: list(own)}
    for a, b in interactions:
        own = {f"{x}:{y}": cols[x] * cols[y] for x in terms[a] for y in terms[b]}
        cols, terms = cols | own, terms | {f"{a}:{b}": list(own)}
    return cols, terms


def _inverse(s: np.ndarray) -> tuple[np.ndarray, int]:
    """Inverse and rank of cross products, a generalised inverse where columns depend on each other."""
    size = np.sqrt(np.where(np.diag(s) > 0, np.diag(s), 1.0))
    value, vector = np.linalg.eigh(s / np.outer(size, size))
    real = value > 1e-12 * max(1, len(value)) * value.max(initial=0)
    return (vector[:, real] / value[real]) @ vector[:, real].T / np.outer(size, size), int(real.sum())


def ols_inference(df: DataFrame, y: str | Column, xs: dict[str, Column], cov: str = "plain", cluster: str | None = None, weight: Column | None = None, intercept: bool = True) -> tuple[list[tuple], float, float]:
    """Rows (name, coef, se, t, p, low, high), R^2 and F.  ``cov``: plain, HC3, or cluster (with the column ``cluster``).

    Rows with a null anywhere are left out of all sums.  With ``weight`` it is weighted least squares, and leverages
    and scores are those of the weighted rows.  Without ``intercept``, R^2 and F are about zero.  Columns that depend on
    each other share their effect, and the rank takes the place of their number.  The coefficients take one moment job,
    robust errors a second pass that sums each row's or cluster's scores.
    """
    label = F.col(y) if isinstance(y, str) else y
    names = [*(["intercept"] if intercept else []), *xs]
    m = gram(df, xs, label, weight=weight)[()]
    n = m.rows
    if intercept:
        mean, s, c, total, at = m.centered()
        inner, rank = _inverse(s)
        slope = inner @ c
        beta, rank = np.append(at - mean @ slope, slope), rank + 1
        inv = np.block([[np.array([[1 / m.n + mean @ inner @ mean]]), -(mean @ inner)[None, :]], [-(inner @ mean)[:, None], inner]])
        sse = total - slope @ c
    else:
        whole = _uncentered(m.matrix, m.center)
        inv, rank = _inverse(whole[1:-1, 1:-1])
        beta, total = inv @ whole[1:-1, -1], whole[-1, -1]
        sse = total - beta @ whole[1:-1, -1]
    d, k = n - rank, len(names)
    if cov == "plain":
        v = sse / d * inv
    else:
        z, w = [*([F.lit(1.0)] if intercept else []), *xs.values()], F.lit(1.0) if weight is None else weight.cast("double")
        e = label - sum((float(b) * x for b, x in zip(beta, z, strict=True)), F.lit(0.0))
        if cov == "HC3":
            h = w * sum((float(inv[i, j]) * z[i] * z[j] for i in range(k) for j in range(k)), F.lit(0.0))
            meat = gram(df.withColumn("__w", F.pow(w * e / (1 - h), 2)), xs, F.lit(0.0), weight=F.col("__w"))[()]
            raw = _uncentered(meat.matrix[:-1, :-1], meat.center[:-1])
            v = inv @ (raw if intercept else raw[1:, 1:]) @ inv
        else:
            sums = df.filter((w * e).isNotNull()).groupBy(cluster).agg(*(F.sum(w * e * x).alias(f"__s{i}") for i, x in enumerate(z)))
            v = _clustered(sums, k, inv, n, rank)
    t975, out = dist.t_quantile(0.05, d), []
    for name, b, var in zip(names, beta, np.diag(v), strict=True):
        se = math.sqrt(max(var, 0.0))
        t = b / se if se else math.copysign(math.inf, b)
        out.append((name, float(b), se, t, dist.t_sf2(t, d) if se else 0.0, b - t975 * se, b + t975 * se))
    return out, 1 - sse / total, ((total - sse) / max(rank - intercept, 1)) / (sse / d)


def _clustered(sums: DataFrame, k: int, inv: np.ndarray, n: float, rank: int) -> np.ndarray:
    """The sandwich of each cluster's summed scores (columns __s0, __s1, ...), corrected for few clusters."""
    row = sums.agg(F.count(F.lit(1)).alias("g"), *(F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k))).first()
    raw = np.array([[row[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
    return inv @ raw @ inv * (row.g / (row.g - 1) * (n - 1) / (n - rank))


def classifiers(df: DataFrame, y: Column, cols: list[str], held_out: Column, depth: int = 3) -> DataFrame:
    """(model, auc, column, importance) of a logistic regression (standardised coefficients by size) and a shallow tree, AUC on the held-out rows."""
    data = df.select(*(F.col(c).cast("double").alias(c) for c in cols), y.cast("double").alias("__y"), held_out.alias("__held")).na.drop()
    data = VectorAssembler(inputCols=cols, outputCol="__features").transform(data)
    train, test = data.filter("not __held"), data.filter("__held")
    spread = np.array([x or 0.0 for x in train.agg(*(F.stddev_pop(c) for c in cols)).first()])
    auc, out = BinaryClassificationEvaluator(labelCol="__y", rawPredictionCol="__raw"), []
    names = {"featuresCol": "__features", "labelCol": "__y", "rawPredictionCol": "__raw", "probabilityCol": "__p", "predictionCol": "__pred"}
    for name, job in (("logistic", LogisticRegression(**names)), ("tree", DecisionTreeClassifier(maxDepth=depth, seed=42, **names))):
        fit = job.fit(train)
        size = np.abs(fit.coefficients.toArray()) * spread if name == "logistic" else fit.featureImportances.toArray()
        score = float(auc.evaluate(fit.transform(test)))
        out += [(name, score, c, float(v / (size.sum() or 1.0))) for c, v in zip(cols, size, strict=True)]
    return df.sparkSession.createDataFrame(out, "model string, auc double, column string, importance double")


def evidence_score(evidence: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``evidence`` (p, p_controlled, agreement, importance_rank, zeroed) with ``score`` from 0 to 100.

    Strong: significant alone and with controls, most models agree, among the first three by importance: 75 to 100 with
    the agreement.  None: a zero coefficient, not significant, of low rank: 0 to 15.  Between them, moderate is one
    significant result with half of the models or more (40 to 70), weak the rest (15 to 40).
    """
    p, controlled, share, rank = (F.coalesce(F.col(c).cast("double"), F.lit(d)) for c, d in (("p", 1.0), ("p_controlled", 1.0), ("agreement", 0.0), ("importance_rank", 99.0)))
    alone, both = p < alpha, (p < alpha) & (controlled < alpha)
    level = F.when(both & (share >= 0.5) & (rank <= 3), 75 + 25 * share).when((alone | (controlled < alpha)) & (share >= 0.5), 40 + 30 * share)
    none = F.coalesce(F.col("zeroed"), F.lit(False)) & ~alone & ~(controlled < alpha) & (rank > 3)
    return evidence.withColumn("score", F.round(F.when(none, 15 * share).otherwise(F.coalesce(level, 15 + 25 * share)), 2))


def _uncentered(base: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Weighted cross products of (1, columns...) without centers, from those about ``center``."""
    c = np.concatenate([[0.0], center])
    first = base[0]
    return base + np.outer(first, c) + np.outer(c, first) + base[0, 0] * np.outer(c, c)
