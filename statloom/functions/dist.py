"""Distribution functions in plain Python, for result-sized frames.

Scalars throughout: a result has as many rows as there are tests. Each function
that a query needs comes as a pandas UDF from :func:`column`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def norm_cdf(z: float) -> float:
    return norm_sf(-z)


def _inverse(sf: Callable[[float], float], p: float, lo: float, hi: float) -> float:
    """x with sf(x) = p for a falling sf, by bisection after widening the bracket."""
    while sf(hi) > p and hi < 1e300:
        hi *= 2
    while lo < 0 and sf(lo) < p:
        lo *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sf(mid) > p else (lo, mid)
        if hi - lo <= 1e-14 * max(1.0, abs(hi)):
            break
    return (lo + hi) / 2


def norm_isf(p: float) -> float:
    return _inverse(norm_sf, p, -1.0, 1.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    out = d
    for m in range(1, 200_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1 / _TINY
    d = out = 1 / b
    for i in range(1, 100_000):
        an, b = -i * (i - a), b + 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out * front


def chi2_sf(x: float, df: float) -> float:
    return gammaincc(df / 2, x / 2)


def chi2_isf(p: float, df: float) -> float:
    return _inverse(lambda x: chi2_sf(x, df), p, 0.0, 1.0)


def f_sf(x: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def t_sf(t: float, df: float) -> float:
    half = betainc(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


def t_isf(p: float, df: float) -> float:
    return _inverse(lambda x: t_sf(x, df), p, -1.0, 1.0)


def t_p(t: float, df: float, alternative: str = "two-sided") -> float:
    if alternative == "two-sided":
        return min(1.0, 2 * t_sf(abs(t), df))
    return t_sf(t, df) if alternative == "greater" else t_sf(-t, df)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)
_ERFC = np.vectorize(math.erfc)


def _range_cdf(w: np.ndarray, k: float) -> np.ndarray:
    """P(range of k standard normals <= w)."""
    z = _NODES * 8.5
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * 8.5 * _WEIGHTS
    low = 0.5 * _ERFC(-z / math.sqrt(2))
    up = 0.5 * _ERFC(-(z[None, :] + w[:, None]) / math.sqrt(2))
    return np.clip(k * ((up - low) ** (k - 1) @ phi), 0, 1)


def studentized_range_sf(q: float, k: float, df: float) -> float:
    """P(studentised range of k means with df degrees of freedom > q), by quadrature over the scale."""
    if q <= 0:
        return 1.0
    if df > 1e5:
        return float(1 - _range_cdf(np.array([q]), k)[0])
    spread = 8 / math.sqrt(2 * df)
    lo, hi = max(1e-8, 1 - spread), 1 + spread
    if df < 20:
        lo, hi = 1e-8, 1 + 12 / math.sqrt(df)
    s = (hi + lo) / 2 + (hi - lo) / 2 * _NODES
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1.0, max(0.0, 1 - (np.exp(log) * _WEIGHTS * (hi - lo) / 2) @ _range_cdf(q * s, k))))


def studentized_range_isf(p: float, k: float, df: float) -> float:
    return _inverse(lambda x: studentized_range_sf(x, k, df), p, 0.0, 4.0)


def column(fn: Callable[..., float], *args) -> Column:
    """``fn`` over columns of a small result frame; null where an argument is null or the result is not a number."""

    @F.pandas_udf("double")
    def apply(*series: pd.Series) -> pd.Series:
        def one(*values):
            if any(v is None or v != v for v in values):
                return None
            try:
                out = fn(*values)
            except (ValueError, ZeroDivisionError, OverflowError):
                return None
            return out if out == out else None

        return pd.Series([one(*row) for row in zip(*series)], dtype="float64")

    return apply(*[a if isinstance(a, Column) else F.lit(a) for a in args])
