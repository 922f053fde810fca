"""Readable models: a list of terms that is a Column, an SQL expression, a card and a table at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.order import running


#: Arithmetic operations of a term beside its product with the coefficient and the sum.
OPERATIONS = {"linear": 0, "hinge": 2, "step": 1, "square": 2, "kink": 2, "interact": 3, "gate": 2, "clipped": 2, "sin": 1, "decay": 3, "spline": 12}


def number(x: float) -> str:
    """A double as SQL writes it."""
    return f"({float(x)!r})" if "e" in repr(float(x)) else f"({float(x)!r}e0)"


@dataclass(frozen=True)
class Term:
    """coef times a basis function: linear, hinge, step, square, kink, interact (about ``knot`` and ``high``), gate, clipped (to ``knot`` and ``high``), sin, decay or spline.

    A spline begins at ``knot``, has the degree ``direction`` and knots ``high`` apart, of the column held within ``bounds``.
    """

    kind: str
    a: str
    coef: float
    b: str | None = None
    knot: float = 0.0
    direction: int = 1
    high: float = 0.0
    bounds: tuple[float, float] | None = None

    def _pieces(self, place, positive, power) -> object:
        """The spline's sum of truncated powers, of Columns or of SQL; the place is held within its support."""
        from .splines import pieces

        return [(f, power(positive(place, k), self.direction)) for k, f in enumerate(pieces(self.direction))]

    def _spline(self) -> Column:
        x = F.greatest(F.least(F.col(self.a).cast("double"), F.lit(self.bounds[1])), F.lit(self.bounds[0]))
        place = F.greatest(F.least((x - self.knot) / self.high, F.lit(self.direction + 1.0)), F.lit(0.0))
        positive = lambda v, k: F.greatest(v - float(k), F.lit(0.0))
        power = lambda v, d: F.pow(v, F.lit(float(d))) if d > 1 else v if d else (v > 0).cast("double")
        parts = self._pieces(place, positive, power)
        return F.when(F.col(self.a).isNotNull(), reduce(lambda a, b: a + b, [f * v for f, v in parts]))

    def _spline_sql(self) -> str:
        x = f'greatest(least("{self.a}", {number(self.bounds[1])}), {number(self.bounds[0])})'
        place = f"greatest(least(({x} - {number(self.knot)}) / {number(self.high)}, {number(self.direction + 1)}), 0e0)"
        positive = lambda v, k: f"greatest({v} - {number(k)}, 0e0)"
        power = lambda v, d: f"power({v}, {d})" if d > 1 else v if d else f"CASE WHEN {v} > 0 THEN 1e0 ELSE 0e0 END"
        return f'CASE WHEN "{self.a}" IS NOT NULL THEN ' + " + ".join(f"{number(f)} * {v}" for f, v in self._pieces(place, positive, power)) + " END"

    def column(self) -> Column:
        x, other = F.col(self.a), F.col(self.b) if self.b else None
        return {
            "linear": lambda: x,
            "hinge": lambda: C.hinge(x, self.knot, self.direction),
            "step": lambda: C.step(x, self.knot),
            "square": lambda: C.square(x, self.knot),
            "kink": lambda: C.kink(x, self.knot),
            "interact": lambda: C.interact(x, other, self.knot, self.high),
            "gate": lambda: C.gate(x, self.knot, other),
            "clipped": lambda: C.clip(x, self.knot, self.high),
            "sin": lambda: F.sin(x),
            "decay": lambda: F.exp(-F.abs(x)),
            "spline": self._spline,
        }[self.kind]()

    def sql(self) -> str:
        if self.kind == "spline":
            return self._spline_sql()
        a, b, t, h = f'"{self.a}"', f'"{self.b}"', number(self.knot), number(self.high)
        return {
            "linear": a,
            "hinge": f"greatest(0e0, {a} - {t})" if self.direction > 0 else f"greatest(0e0, {t} - {a})",
            "step": f"CASE WHEN {a} > {t} THEN 1e0 ELSE 0e0 END",
            "square": f"({a} - {t}) * ({a} - {t})",
            "kink": f"abs({a} - {t})",
            "interact": f"({a} - {t}) * ({b} - {h})" if self.knot or self.high else f"{a} * {b}",
            "gate": f"CASE WHEN {a} > {t} THEN {b} ELSE 0e0 END",
            "clipped": f"CASE WHEN {a} IS NOT NULL THEN least(greatest({a}, {t}), {h}) END",
            "sin": f"sin({a})",
            "decay": f"exp(-abs({a}))",
        }[self.kind]

    def text(self) -> str:
        t, h = f"{self.knot:g}", f"{self.high:g}"
        return {
            "linear": self.a,
            "hinge": f"max(0, {self.a} - {t})" if self.direction > 0 else f"max(0, {t} - {self.a})",
            "step": f"[{self.a} > {t}]",
            "square": f"({self.a} - {t})^2",
            "kink": f"|{self.a} - {t}|",
            "interact": f"({self.a} - {t}) * ({self.b} - {h})" if self.knot or self.high else f"{self.a} * {self.b}",
            "gate": f"[{self.a} > {t}] * {self.b}",
            "clipped": f"{self.a} held in [{t}, {h}]",
            "sin": f"sin({self.a})",
            "decay": f"exp(-|{self.a}|)",
            "spline": f"spline({self.a}, from {t})",
        }[self.kind]


@dataclass
class TermModel:
    """The printed equation is exactly what scores."""

    terms: list[Term]
    intercept: float

    def column(self) -> Column:
        out = F.lit(float(self.intercept))
        for t in self.terms:
            out = out + F.lit(float(t.coef)) * t.column()
        return out

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return df.withColumn(out, self.column())

    def sql(self) -> str:
        return " + ".join([number(self.intercept), *(f"{number(t.coef)} * ({t.sql()})" for t in self.terms)])

    def card(self) -> str:
        lines = [f"y = {self.intercept:.6g}"]
        lines += [f"  {t.coef:+.6g} * {t.text()}" for t in sorted(self.terms, key=lambda t: -abs(t.coef)) if t.coef]
        used = {t.a for t in self.terms if t.coef} | {t.b for t in self.terms if t.coef and t.b}
        none = sorted({t.a for t in self.terms} - used)
        return "\n".join([*lines, f"no effect: {', '.join(none)}"] if none else lines)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t.kind, t.a, t.b, float(t.knot), t.direction, float(t.coef)) for i, t in enumerate(self.terms)]
        return spark.createDataFrame([(-1, "intercept", None, None, None, None, float(self.intercept)), *rows], "ord int, kind string, a string, b string, knot double, dir int, coef double")

    def columns(self) -> list[str]:
        """The columns with a coefficient."""
        return sorted({x for t in self.terms if t.coef for x in (t.a, t.b) if x})

    def operations(self) -> int:
        """Arithmetic operations that one prediction takes."""
        return sum(2 + OPERATIONS[t.kind] for t in self.terms if t.coef)

    def ranking(self, cols: list[str] = ()) -> list[tuple[str, float]]:
        """(column, share of the sizes of the coefficients), the largest first; a term of two columns counts half for each, ``cols`` without any are 0."""
        size = dict.fromkeys(cols, 0.0)
        for t in self.terms:
            of = [x for x in (t.a, t.b) if x]
            for x in of:
                size[x] = size.get(x, 0.0) + abs(t.coef) / len(of)
        total = sum(size.values()) or 1.0
        return sorted(((c, v / total) for c, v in size.items()), key=lambda x: (-x[1], x[0]))

    def contributions(self, df: DataFrame, key: list[str]) -> DataFrame:
        """Each row's part of every term."""
        parts = F.array(*(F.struct(F.lit(t.text()).alias("term"), (F.lit(float(t.coef)) * t.column()).alias("part")) for t in self.terms))
        return df.select(*key, F.inline(parts))

    def importance(self, df: DataFrame) -> DataFrame:
        """Mean absolute deviation of each term's part from its mean, and its share."""
        means = df.agg(*(F.avg(F.lit(float(t.coef)) * t.column()) for t in self.terms)).first()
        row = df.agg(*(F.avg(F.abs(F.lit(float(t.coef)) * t.column() - float(m or 0))) for t, m in zip(self.terms, means, strict=True))).first()
        total = sum(x or 0 for x in row) or 1.0
        return df.sparkSession.createDataFrame([(t.text(), float(x or 0), float(x or 0) / total) for t, x in zip(self.terms, row, strict=True)], "term string, importance double, share double")


def linear_model(equation) -> TermModel:
    return TermModel([Term("linear", n, float(c)) for n, c in zip(equation.names, equation.coef, strict=True)], equation.intercept)


def honesty(df: DataFrame, card: Column, batch: Column) -> DataFrame:
    """How far the printed equation and a batch prediction are apart."""
    return df.agg(F.pow(F.corr(card, batch), 2).alias("r2"), F.max(F.abs(card - batch)).alias("max_gap"))


def effect_curve(model, df: DataFrame, cols: list[str], col: str, points: int = 60) -> DataFrame:
    """Predictions along a grid of ``col`` with the other ``cols`` at their medians (within a ten-thousandth of the rank)."""
    others = [c for c in cols if c != col]
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), *(F.percentile_approx(c, 0.5, 10_000).alias(f"m_{i}") for i, c in enumerate(others))).first()
    grid = df.sparkSession.range(points).select((F.lit(float(row.lo)) + F.col("id") * float((row.hi - row.lo) / max(1, points - 1))).alias(col), *(F.lit(float(row[f"m_{i}"])).alias(c) for i, c in enumerate(others)))
    return model.transform(grid).select(col, "pred")


def effect_slope(curve: DataFrame, col: str) -> DataFrame:
    """The straight line through an effect curve, and what it explains."""
    return curve.agg(F.regr_slope("pred", col).alias("slope"), F.regr_r2("pred", col).alias("r2"))


def toggle_effect(model, df: DataFrame, col: str) -> DataFrame:
    """The mean change of the prediction when a flag goes from 0 to 1, in one pass."""
    on = model.transform(df.withColumn(col, F.lit(1.0)), "__on")
    return model.transform(on.withColumn(col, F.lit(0.0)), "__off").agg(F.avg(F.col("__on") - F.col("__off")).alias("effect"))


def probe(model, points: DataFrame, key: str) -> DataFrame:
    """The few rows of ``points`` with their predictions and how far these are from that of the first by ``key``."""
    scored = model.transform(points)
    first = scored.agg(F.min_by("pred", key).alias("__first"))
    return scored.crossJoin(F.broadcast(first)).withColumn("difference", F.col("pred") - F.col("__first")).drop("__first").orderBy(key)  # one row


def permutation_importance(model, df: DataFrame, cols: list[str], label: Column, seed: int = 42) -> DataFrame:
    """(column, rmse, increase): the error when a column's values go to other rows, and how much more that is than without.

    All columns are moved by one step in one random order of the rows, found by ranges; one join brings them beside
    the rows and one pass sums all errors.
    """
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in cols), label.cast("double").alias("__y")).na.drop()
    rows = rows.withColumns({"__h": F.xxhash64(*cols, "__y", F.lit(seed)), "__one": F.lit(1)})
    placed = running(rows, ["__h", "__y"], "__one", "__at")
    n = max(placed.count(), 1)
    moved = placed.select(F.pmod(F.col("__at") + 1, F.lit(n)).alias("__at"), *(F.col(c).alias(f"__m{i}") for i, c in enumerate(cols)))
    data = model.transform(placed.select("__at", "__y", *cols).join(moved, "__at"), "__p")
    for i, c in enumerate(cols):
        data = model.transform(data.withColumns({"__keep": F.col(c), c: F.col(f"__m{i}")}), f"__p{i}").withColumn(c, F.col("__keep"))
    rmse = lambda p: F.sqrt(F.avg(F.pow(F.col("__y") - F.col(p), 2)))
    row = data.agg(rmse("__p").alias("base"), *(rmse(f"__p{i}").alias(f"e{i}") for i in range(len(cols)))).first()
    return df.sparkSession.createDataFrame([(c, row[f"e{i}"], row[f"e{i}"] - row.base) for i, c in enumerate(cols)] if row.base is not None else [], "column string, rmse double, increase double")
