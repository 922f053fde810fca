"""Generalised linear models with their inference: logistic, Poisson and negative-binomial regression, model or robust errors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..plans.gram import gram
from ..sources.scratch import materialise

LINKS = {"binomial": "logit", "poisson": "log"}


@dataclass(frozen=True)
class Effect:
    """A coefficient with its normal inference; ``ratio`` is its odds or rate ratio."""

    name: str
    coef: float
    se: float

    @property
    def z(self) -> float:
        return self.coef / self.se

    @property
    def p(self) -> float:
        return min(1.0, 2 * dist.normal_sf(abs(self.z)))

    @property
    def interval(self) -> tuple[float, float]:
        return self.coef - 1.959963984540054 * self.se, self.coef + 1.959963984540054 * self.se

    @property
    def ratio(self) -> float:
        return math.exp(self.coef)


def _rows(df: DataFrame, y: Column, xs: dict[str, Column], offset: Column | None, weight: Column | None, cluster: Column | None = None) -> DataFrame:
    """Complete rows as doubles: y, offset, weight and x0, x1, ..., and the cluster as it is."""
    cols = {"y": y, "offset": F.lit(0.0) if offset is None else offset, "weight": F.lit(1.0) if weight is None else weight}
    cols |= {f"x{i}": c for i, c in enumerate(xs.values())}
    return df.select(*(c.cast("double").alias(n) for n, c in cols.items()), *([] if cluster is None else [cluster.alias("cluster")])).na.drop()


#: Errors from the model, from each row's score (``HC1`` corrected for the number of columns), or from each cluster's.
ERRORS = ("plain", "HC0", "HC1", "cluster")


def glm(df: DataFrame, y: Column, xs: dict[str, Column], family: str = "binomial", offset: Column | None = None, weight: Column | None = None, cov: str = "plain", cluster: Column | None = None) -> list[Effect]:
    """Intercept and coefficients of a logistic (0/1, or shares with trials as ``weight``) or Poisson regression.

    Robust errors take one more job, which sums the information and the products of the scores of rows or clusters.
    """
    if cov not in ERRORS or (cov == "cluster") != (cluster is not None):
        raise ValueError(f"one of {ERRORS} is expected, and a cluster for the last one only")
    names = [f"x{i}" for i in range(len(xs))]
    rows = _rows(df, y, xs, offset, weight, cluster)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    job = GeneralizedLinearRegression(family=family, link=LINKS[family], labelCol="y", weightCol="weight", offsetCol="offset", maxIter=50, tol=1e-10)
    fit = job.fit(data)
    *errors, error = fit.summary.coefficientStandardErrors
    beta, errors = [float(fit.intercept), *map(float, fit.coefficients)], [error, *errors]
    if cov != "plain":
        errors = np.sqrt(np.diag(_sandwich(rows, beta, family, cov)))
    return [Effect(n, b, float(e)) for n, b, e in zip(["intercept", *xs], beta, errors, strict=True)]


def _sandwich(rows: DataFrame, beta: list[float], family: str, cov: str) -> np.ndarray:
    """inv(A) B inv(A) with the information A and the summed products B of scores, both of canonical links."""
    z = [F.lit(1.0), *(F.col(f"x{i}") for i in range(len(beta) - 1))]
    k, eta = len(z), F.col("offset") + sum((b * x for b, x in zip(beta[1:], z[1:], strict=True)), F.lit(beta[0]))
    mu = F.exp(eta) if family == "poisson" else 1 / (1 + F.exp(-eta))
    scored = rows.withColumn("mu", mu).withColumn("info", F.col("weight") * (F.col("mu") if family == "poisson" else F.col("mu") * (1 - F.col("mu")))).withColumn("score", F.col("weight") * (F.col("y") - F.col("mu")))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    scores = [F.col("score") * x for x in z]
    if cov == "cluster":
        by = scored.groupBy("cluster").agg(*(F.sum(s).alias(f"s{i}") for i, s in enumerate(scores)), *(F.sum(F.col("info") * z[i] * z[j]).alias(f"a{i}_{j}") for i, j in pairs), F.count(F.lit(1)).alias("n"))
        row = by.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), *(F.sum(f"a{i}_{j}").alias(f"a{i}_{j}") for i, j in pairs), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"b{i}_{j}") for i, j in pairs)).first()
        scale = row.g / (row.g - 1) * (row.n - 1) / (row.n - k)
    else:
        row = scored.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("info") * z[i] * z[j]).alias(f"a{i}_{j}") for i, j in pairs), *(F.sum(scores[i] * scores[j]).alias(f"b{i}_{j}") for i, j in pairs)).first()
        scale = row.n / (row.n - k) if cov == "HC1" else 1.0
    info, meat = np.zeros((k, k)), np.zeros((k, k))
    for i, j in pairs:
        info[i, j] = info[j, i] = row[f"a{i}_{j}"]
        meat[i, j] = meat[j, i] = row[f"b{i}_{j}"]
    inv = np.linalg.inv(info)
    return inv @ meat @ inv * scale


def negbin(df: DataFrame, y: Column, xs: dict[str, Column], rounds: int = 25) -> tuple[list[Effect], float]:
    """Negative-binomial regression with log link (variance mu + a mu^2), and its dispersion ``a`` by Pearson's statistic.

    ``negbin_ml`` has the dispersion of greatest likelihood.  Each round is a weighted moment job on the working response; the dispersion is that at which Pearson's statistic
    equals its degrees of freedom, found on a grid of which one job sums all points, refined twice; 0 for data that
    vary no more than a Poisson variable.
    """
    rows = materialise(_rows(df, y, xs, None, None), "counts")  # read in every round
    cols = {n: F.col(f"x{i}") for i, n in enumerate(xs)}
    start = rows.agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).first()
    beta, a = np.array([math.log(max(start.m or 0.0, 1e-9)), *[0.0] * len(xs)]), 0.0

    def mean() -> Column:
        return F.exp(sum((float(b) * c for b, c in zip(beta[1:], cols.values(), strict=True)), F.lit(float(beta[0]))))

    for _ in range(rounds):
        mu, old = mean(), (beta, a)
        fit = gram(rows, cols, F.log(mu) + (F.col("y") - mu) / mu, weight=mu / (1 + a * mu))[()]
        at, s, c, _, label = fit.centered()
        slope = np.linalg.solve(s, c)
        beta = np.array([label - at @ slope, *slope])
        a = _dispersion(rows, mean(), start.n - len(beta))
        if np.abs(beta - old[0]).max() < 1e-8 and abs(a - old[1]) < 1e-6 * max(a, 1e-6):
            break
    mu = mean()
    at, s, _, _, _ = (last := gram(rows, cols, F.col("y"), weight=mu / (1 + a * mu))[()]).centered()
    inner = np.linalg.inv(s)
    errors = np.sqrt([1 / last.n + at @ inner @ at, *np.diag(inner)])
    return [Effect(n, float(b), float(e)) for n, b, e in zip(["intercept", *xs], beta, errors, strict=True)], a


def _dispersion(rows: DataFrame, mu: Column, df: int) -> float:
    low, high = 1e-6, 1e4
    for _ in range(3):
        grid = np.geomspace(low, high, 48)
        sums = rows.select("y", mu.alias("mu")).agg(*(F.sum(F.pow(F.col("y") - F.col("mu"), 2) / (F.col("mu") + float(a) * F.pow("mu", 2))).alias(f"a{i}") for i, a in enumerate(grid))).first()
        above = [i for i, v in enumerate(sums) if v > df]  # the statistic falls as the dispersion grows
        if not above:
            return 0.0
        i = min(above[-1], len(grid) - 2)
        low, high = grid[i], grid[i + 1]
    return math.sqrt(low * high)


@dataclass(frozen=True)
class NegativeBinomial:
    """Effects, the dispersion with its error (0 and none at the border to Poisson), and the log likelihood."""

    effects: list[Effect]
    dispersion: float
    dispersion_se: float | None
    log_likelihood: float


#: A dispersion that falls to this is that of a Poisson model.
LEAST_DISPERSION = 1e-6


def _series(x: Column) -> tuple[Column, Column, Column]:
    """lgamma, digamma and trigamma of positive ``x``: Stirling's series at ``x + 8``, and the eight steps back."""
    z = x + 8
    r = 1 / (z * z)
    # Coefficients of Stirling's series and its derivatives (fixed values).
    gamma = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / z
    first = F.log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    second = 1 / z + r / 2 + r / z * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))
    for k in range(8):
        gamma, first, second = gamma - F.log(x + k), first - 1 / (x + k), second + 1 / ((x + k) * (x + k))
    return gamma, first, second


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function of positive numbers, in generated code."""
    return _series(x)[0]


def negbin_ml(df: DataFrame, y: Column, xs: dict[str, Column], offset: Column | None = None, rounds: int = 60) -> NegativeBinomial:
    """Negative-binomial regression with log link (variance mu + a mu^2) of greatest likelihood, dispersion and all.

    A round is two jobs: one over the rows for the coefficients' score and information, and one for the dispersion's.
    The gamma terms depend on a row's count only, so they are sums over the distinct counts, a table that is made once.
    Coefficients take scoring steps and the dispersion Newton steps of its logarithm, halved until the likelihood
    grows.  Errors are those of the joint observed information.  For data that vary no more than a Poisson variable
    does, the dispersion goes to 0 and the model is Poisson.
    """
    rows = materialise(_rows(df, y, xs, offset, None), "counts")  # read in every round
    table = materialise(rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "counts")
    start = rows.agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"), F.avg("offset").alias("o"), F.count(F.lit(1)).alias("n")).first()
    if not start.n or not start.m:
        raise ValueError("counts that aren't all zero are expected")
    z = [F.lit(1.0), *(F.col(f"x{i}") for i in range(len(xs)))]
    k, pairs = len(z), [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    names = ["intercept", *xs]

    def sums(beta: np.ndarray, a: float) -> dict:
        """Log likelihood, scores and second derivatives in the coefficients and the dispersion."""
        r = 1 / a
        eta = F.col("offset") + sum((float(b) * x for b, x in zip(beta[1:], z[1:], strict=True)), F.lit(float(beta[0])))
        q = rows.withColumn("mu", F.exp(eta))
        mu, v, away = F.col("mu"), F.col("y"), F.col("y") - F.col("mu")
        by_row = {"ll": v * F.log(mu / (r + mu)) - r * F.log1p(a * mu), "r1": -F.log1p(a * mu) - away / (r + mu), "r2": 1 / F.lit(r) - 1 / (r + mu) + away / F.pow(r + mu, 2)}
        for i in range(k):
            by_row |= {f"s{i}": away * r / (r + mu) * z[i], f"c{i}": mu * away / F.pow(r + mu, 2) * z[i]}
        for i, j in pairs:
            by_row |= {f"e{i}_{j}": mu * r / (r + mu) * z[i] * z[j], f"o{i}_{j}": mu * r * (v + r) / F.pow(r + mu, 2) * z[i] * z[j]}
        found = q.agg(*(F.sum(c).alias(n) for n, c in by_row.items())).first().asDict()
        gamma, first, second = _series(F.col("y") + r)
        own = table.agg(F.sum(F.col("n") * (gamma - lgamma(F.col("y") + 1))).alias("ll"), F.sum(F.col("n") * first).alias("r1"), F.sum(F.col("n") * second).alias("r2"), F.first(F.array(*_series(F.lit(float(r))))).alias("at")).first()
        for n, at in zip(("ll", "r1", "r2"), own.at, strict=True):
            found[n] += own[n] - start.n * at
        square = lambda c: np.array([[found[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        return found | {"expected": square("e"), "observed": square("o"), "s": np.array([found[f"s{i}"] for i in range(k)]), "c": np.array([found[f"c{i}"] for i in range(k)])}

    beta = np.array([math.log(start.m) - (start.o or 0.0), *[0.0] * len(xs)])
    log_a = math.log(max(1e-3, ((start.v or 0.0) - start.m) / start.m**2))
    now = sums(beta, math.exp(log_a))
    for _ in range(rounds):
        a = math.exp(log_a)
        r = 1 / a
        slope, bend = -now["r1"] * r, now["r2"] * r * r + now["r1"] * r  # in the logarithm of a
        step_a = float(np.clip(-slope / bend if bend < 0 else math.copysign(1.0, slope), -2, 2))
        step = np.linalg.solve(now["expected"], now["s"])
        for half in range(20):
            tried = beta + step / 2**half, max(log_a + step_a / 2**half, math.log(LEAST_DISPERSION))
            then = sums(tried[0], math.exp(tried[1]))
            if then["ll"] >= now["ll"] - 1e-9 * abs(now["ll"]):
                break
        done = abs(then["ll"] - now["ll"]) < 1e-12 * abs(now["ll"]) or max(np.abs(tried[0] - beta).max(), abs(tried[1] - log_a)) < 1e-9
        (beta, log_a), now = tried, then
        if done:
            break
    a = math.exp(log_a)
    if a <= 1.01 * LEAST_DISPERSION:  # the scoring steps were those of a Poisson model
        errors = np.sqrt(np.diag(np.linalg.inv(now["expected"])))
        return NegativeBinomial([Effect(n, float(b), float(e)) for n, b, e in zip(names, beta, errors, strict=True)], 0.0, None, float(now["ll"]))
    # Second derivatives in (coefficients, a): r = 1 / a.
    r = 1 / a
    info = np.zeros((k + 1, k + 1))
    info[:k, :k] = now["observed"]
    info[:k, k] = info[k, :k] = now["c"] * r * r
    info[k, k] = -(now["r2"] * r**4 + 2 * now["r1"] * r**3)
    errors = np.sqrt(np.diag(np.linalg.inv(info)))
    return NegativeBinomial([Effect(n, float(b), float(e)) for n, b, e in zip(names, beta, errors[:k], strict=True)], a, float(errors[k]), float(now["ll"]))
