"""Tails of the normal, t, F and chi-squared distributions by continued fractions and series."""

from __future__ import annotations

import math


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, value, m = 1.0, 1 / _away(1 - (a + b) * x / (a + 1)), 0.0, 0
    value = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / _away(1 + top * d), _away(1 + top / c)
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def _away(x: float) -> float:
    return x if abs(x) > 1e-300 else 1e-300


def gamma_sf(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * total:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    value = d
    for i in range(1, 1000):
        top, b = -i * (i - a), b + 2
        d, c = 1 / _away(top * d + b), _away(b + top / c)
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def normal_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def t_sf2(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def t_quantile(p: float, df: float) -> float:
    """The point that |T| exceeds with probability ``p``."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf2(mid, df) > p else (low, mid)
    return low
