"""Column helpers: cleaning, guarded arithmetic, bins and the basis functions of readable models."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric(name: str) -> Column:
    """A column as double: what doesn't parse, NaN and infinities become null."""
    c = F.expr(f"try_cast(`{name}` AS double)")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def flag(c: Column, true_values: list[str]) -> Column:
    return F.lower(F.trim(c)).isin([v.lower() for v in true_values]).cast("int")


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """``c`` held within the bounds; null stays null."""
    out = c if low is None else F.greatest(c, F.lit(float(low)))
    out = out if high is None else F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def signed_sqrt(c: Column) -> Column:
    return F.signum(c) * F.sqrt(F.abs(c))


#: Transforms by name; outside its domain a value becomes null.
TRANSFORMS = {
    "log": lambda c: F.when(c > 0, F.log(c)),
    "log1p": lambda c: F.when(c > -1, F.log1p(c)),
    "exp": F.exp,
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)),
    "signed_sqrt": signed_sqrt,
    "square": lambda c: c * c,
    "abs": F.abs,
    "arcsin": lambda c: F.when(F.abs(c) <= 1, F.asin(c)),
    "sin": F.sin,
    "decay": lambda c: F.exp(-F.abs(c)),
}


def transformed(c: Column, kind: str) -> Column:
    return TRANSFORMS[kind](c)


def fourier(names: list[str], count: int, gamma: float = 1.0, seed: int = 42, scale: dict[str, tuple[float, float]] | None = None) -> dict[str, Column]:
    """Random Fourier features: sqrt(2 / count) * cos(w . z + b) with seeded normal ``w`` of variance 2 gamma; ``scale`` has (mean, deviation) of columns."""
    rng, out = np.random.default_rng(seed), {}
    for k in range(count):
        w, b = rng.normal(0.0, (2 * gamma) ** 0.5, len(names)), rng.uniform(0, 2 * np.pi)
        angle = F.lit(float(b))
        for n, v in zip(names, w, strict=True):
            mean, deviation = (scale or {}).get(n, (0.0, 1.0))
            angle = angle + float(v) * (F.col(n) - float(mean)) / float(deviation or 1.0)
        out[f"rff{k}"] = float((2 / count) ** 0.5) * F.cos(angle)
    return out


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def row_mean(*cols: Column) -> Column:
    """The mean of those that aren't null."""
    known = F.filter(F.array(*cols), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def days_between(end: str, start: str, fmt: str) -> Column:
    return F.datediff(F.try_to_timestamp(F.col(end), F.lit(fmt)), F.try_to_timestamp(F.col(start), F.lit(fmt)))


def wrap_cycle(day: Column, length: int) -> Column:
    return F.pmod(day, F.lit(length))


def cut(c: Column, edges: list[float], labels: list) -> Column:
    """Right-closed bins; outside, null."""
    out = F.lit(None)
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((c > low) & (c <= high), F.lit(label)).otherwise(out)
    return out


def hinge(c: Column, knot: float, direction: int = 1) -> Column:
    return F.greatest(F.lit(0.0), (c - knot) if direction > 0 else (knot - c))


def step(c: Column, knot: float) -> Column:
    return F.when(c > knot, 1.0).otherwise(0.0)


def square(c: Column, center: float = 0.0) -> Column:
    return (c - center) * (c - center)


def kink(c: Column, knot: float) -> Column:
    return F.abs(c - knot)


def interact(a: Column, b: Column, ca: float = 0.0, cb: float = 0.0) -> Column:
    return (a - ca) * (b - cb)


def gate(g: Column, knot: float, c: Column) -> Column:
    return F.when(g > knot, c).otherwise(0.0)


def binned(c: Column, edges: list[float]) -> list[Column]:
    """One indicator for each right-closed bin, the outer ones open."""
    bounds = [None, *edges, None]
    out = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        inside = F.lit(True) if low is None else c > low
        inside = inside if high is None else inside & (c <= high)
        out.append(F.when(inside, 1.0).otherwise(0.0))
    return out


def poly2(names: list[str]) -> dict[str, Column]:
    """All columns, their squares and products."""
    cols = {n: F.col(n) for n in names} | {f"{n}^2": F.col(n) * F.col(n) for n in names}
    return cols | {f"{a}*{b}": F.col(a) * F.col(b) for a, b in combinations(names, 2)}
