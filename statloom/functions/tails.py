"""Tails of the usual distributions as column expressions: no Python on the workers.

Continued fractions run as a fold over a sequence inside the expression, as many
steps as the arguments need (their number grows with a square root of them), so
that one method serves all sizes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions.dist import norm_isf

_TINY = 1e-300
#: Log-gamma's Stirling series is used this far above the argument.
_SHIFT = 12


def _lit(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def _let(body, *values: Column) -> Column:
    """``body`` of the values, each of which is worked out once however often it is used."""
    held = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(held), lambda s: body(*[s[f"v{i}"] for i in range(len(values))]))[0]


def _correction(x: Column) -> Column:
    """What Stirling's formula leaves, by Bernoulli numbers."""
    r = 1 / (x * x)
    return (1 / 12 + r * (-1 / 360 + r * (1 / 1260 + r * (-1 / 1680 + r * (1 / 1188 + r * (-691 / 360360)))))) / x


def _sum(f) -> Column:
    """Of ``f(0)`` to ``f(_SHIFT - 1)``."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(0.0), lambda acc, i: acc + f(i))


def ln_gamma(x: Column | float) -> Column:
    x = _lit(x)
    z = x + _SHIFT
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + _correction(z) - _sum(lambda i: F.log(x + i))


def ln_beta(a: Column | float, b: Column | float) -> Column:
    """From the smaller argument's log-gamma and the larger one's growth, which are both of the size of the result."""

    def of(big: Column, small: Column) -> Column:
        z = big + _SHIFT
        growth = (z - 0.5) * F.log1p(small / z) + small * F.log(z + small) - small + _correction(z + small) - _correction(z) - _sum(lambda i: F.log1p(small / (big + i)))
        return ln_gamma(small) - growth

    return _let(of, F.greatest(_lit(a), _lit(b)), F.least(_lit(a), _lit(b)))


def _nonzero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _fraction(steps: Column, start: Column, term) -> Column:
    """Modified Lentz: ``term(j)`` is the j-th partial numerator of 1 + n1 / (1 + n2 / (1 + ...)), whose inverse is returned."""
    first = F.struct(F.lit(1.0).alias("c"), (1 / _nonzero(start)).alias("d"), (1 / _nonzero(start)).alias("out"))

    def step(acc: Column, j: Column) -> Column:
        d = 1 / _nonzero(1 + term(j) * acc["d"])
        c = _nonzero(1 + term(j) / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["out"] * c * d).alias("out"))

    return F.aggregate(F.sequence(F.lit(2), steps), first, step)["out"]


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    def term(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(j % 2 == 0, even).otherwise(odd)

    steps = (F.lit(120) + 2 * F.ceil(F.sqrt(F.least(a, b)))).cast("int")
    return _fraction(steps, 1 - (a + b) * x / (a + 1), term)


def beta_inc(a: Column | float, b: Column | float, x: Column) -> Column:
    """Regularised incomplete beta function."""

    def part(p: Column, q: Column, y: Column) -> Column:
        return F.exp(p * F.log(y) + q * F.log1p(-y) - ln_beta(p, q)) * _beta_fraction(p, q, y) / p

    def of(a: Column, b: Column, x: Column) -> Column:
        near = x < (a + 1) / (a + b + 2)
        value = _let(part, F.when(near, a).otherwise(b), F.when(near, b).otherwise(a), F.when(near, x).otherwise(1 - x))
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(near, value).otherwise(1 - value))

    return _let(of, _lit(a), _lit(b), _lit(x))


def gamma_sf(a: Column | float, x: Column) -> Column:
    """Regularised upper incomplete gamma function: a series below its middle, a continued fraction above."""

    def of(a: Column, x: Column, steps: Column) -> Column:
        front = F.exp(a * F.log(x) - x - ln_gamma(a))
        first = F.struct((1 / a).alias("term"), (1 / a).alias("total"))
        series = F.aggregate(F.sequence(F.lit(1), steps), first, lambda acc, n: F.struct((acc["term"] * x / (a + n)).alias("term"), (acc["total"] + acc["term"] * x / (a + n)).alias("total")))["total"]
        start = F.struct(F.lit(1 / _TINY).alias("c"), (1 / _nonzero(x + 1 - a)).alias("d"), (1 / _nonzero(x + 1 - a)).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            an, bi = -i * (i - a), x + 1 - a + 2 * i
            d = 1 / _nonzero(an * acc["d"] + bi)
            c = _nonzero(bi + an / acc["c"])
            return F.struct(c.alias("c"), d.alias("d"), (acc["out"] * c * d).alias("out"))

        fraction = F.aggregate(F.sequence(F.lit(1), steps), start, step)["out"]
        return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)

    a, x = _lit(a), _lit(x)
    return _let(of, a, x, (F.lit(120) + 8 * F.ceil(F.sqrt(F.greatest(a, x)))).cast("int"))


def norm_sf(z: Column) -> Column:
    z = _lit(z)
    half = gamma_sf(0.5, z * z / 2) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def chi2_sf(x: Column, df: Column | float) -> Column:
    return gamma_sf(_lit(df) / 2, _lit(x) / 2)


def f_sf(x: Column, d1: Column | float, d2: Column | float) -> Column:
    d1, d2 = _lit(d1), _lit(d2)
    return F.when(x > 0, beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))).when(x.isNotNull(), 1.0)


def t_sf(t: Column, df: Column | float) -> Column:
    df = _lit(df)
    half = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return F.when(t >= 0, half).otherwise(1 - half)


def t_p(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    if alternative == "two-sided":
        return beta_inc(_lit(df) / 2, 0.5, df / (df + t * t))
    return t_sf(t, df) if alternative == "greater" else t_sf(-t, df)


def t_isf(p: float, df: Column) -> Column:
    """The point that Student's t exceeds with a chance of ``p`` below a half.

    Newton's method on the logarithms of point and tail, in which heavy tails
    are straight lines and light ones bend one way; it starts at the normal
    distribution's point.
    """

    def of(df: Column, scale: Column) -> Column:
        def closer(u: Column, _: Column) -> Column:
            def move(t: Column, tail: Column) -> Column:
                density = F.exp(scale - (df + 1) / 2 * F.log1p(t * t / df))
                return F.log(t) + (F.log(tail) - math.log(p)) * tail / (t * density)

            return _let(move, F.exp(u), beta_inc(df / 2, 0.5, df / (df + F.exp(2 * u))) / 2)

        return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(math.log(norm_isf(p))), closer))

    df = F.when(_lit(df) > 0, _lit(df))
    return F.when(df.isNotNull(), _let(of, df, -F.log(df) / 2 - ln_beta(df / 2, 0.5)))
