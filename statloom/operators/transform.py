"""Box-Cox transform."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.columns import number, require_numeric

#: Exponents with a plain meaning; one of them is taken if the interval holds it.
PLAIN = (-3.0, -2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 3.0)


#: Powers of a logarithm's distance from its bucket's middle that are summed up.
_POWERS = 8


class LogMoments:
    """Sums of powers of the logarithms of a column, by bucket of value: all that the likelihood of any exponent needs.

    Buckets are so narrow that an exponential of the distance to the middle is
    its power series to double precision. Their number follows from the spread
    of the logarithms, 65,536 at most.
    """

    def __init__(self, df: DataFrame, column: str):
        require_numeric(df, column)
        x = number(column)
        s = df.agg(F.count(x).alias("n"), F.min(x).alias("least"), F.avg(F.log(x)).alias("mean"), F.min(F.log(x)).alias("low"), F.max(F.log(x)).alias("high")).first()
        if not s["n"] or s["least"] <= 0:
            raise ValueError("Box-Cox needs positive values")
        self.n, self.mean_log = s["n"], s["mean"]
        count = int(min(max(math.ceil((s["high"] - s["low"]) * 256), 1), 65_536))
        width = (s["high"] - s["low"]) / count or 1.0
        place = F.least(F.floor((F.log(x) - s["low"]) / width), F.lit(count - 1))
        off = df.select(place.alias("b"), F.log(x).alias("l")).where("l IS NOT NULL").withColumn("d", F.col("l") - (s["low"] + (F.col("b") + 0.5) * width))
        table = off.groupBy("b").agg(*[F.sum(F.pow("d", F.lit(float(k)))).alias(f"m{k}") for k in range(_POWERS + 1)]).orderBy("b").toArrow()
        self.centres = s["low"] + (table["b"].to_numpy() + 0.5) * width - s["mean"]
        self.moments = np.stack([table[f"m{k}"].to_numpy() for k in range(_POWERS + 1)])

    def variance(self, lam: float) -> float:
        """Of the transformed values, scaled by their geometric mean."""
        c, m = self.centres, self.moments
        if abs(lam) < 1e-9:
            first, second = m[0] * c + m[1], m[0] * c * c + 2 * c * m[1] + m[2]
        else:
            k = np.arange(1, _POWERS + 1)
            scale = lam ** (k - 1) / np.array([math.factorial(i) for i in k])
            inner = scale @ m[1:]  # of (exp(lam d) - 1) / lam
            square = (lam ** (k - 2.0) * (2.0**k - 2) / np.array([math.factorial(i) for i in k])) @ m[1:]  # of its square
            base, grown = np.expm1(lam * c) / lam, np.exp(lam * c)
            first, second = m[0] * base + grown * inner, m[0] * base**2 + 2 * base * grown * inner + grown**2 * square
        mean = first.sum() / self.n
        return second.sum() / self.n - mean * mean

    def likelihood(self, lam: float) -> float:
        """Profile log-likelihood of an exponent."""
        return -self.n / 2 * math.log(max(self.variance(lam), 1e-300))


def box_cox_likelihoods(df: DataFrame, column: str, exponents: Sequence[float] = PLAIN) -> DataFrame:
    """``exponent, likelihood``: the profile log-likelihood of each exponent, for values scaled by their geometric mean."""
    moments = LogMoments(df, column)
    return df.sparkSession.createDataFrame([(float(e), float(moments.likelihood(e))) for e in exponents], "exponent double, likelihood double")


def _top(fn, lo: float, hi: float) -> float:
    """Where a function with one peak is greatest, by golden section."""
    share = (math.sqrt(5) - 1) / 2
    a, b = hi - share * (hi - lo), lo + share * (hi - lo)
    fa, fb = fn(a), fn(b)
    while hi - lo > 1e-9:
        if fa < fb:
            lo, a, fa = a, b, fb
            b = lo + share * (hi - lo)
            fb = fn(b)
        else:
            hi, b, fb = b, a, fa
            a = hi - share * (hi - lo)
            fa = fn(a)
    return (lo + hi) / 2


def box_cox_lambda(df: DataFrame, column: str, alpha: float = 0.05) -> dict:
    """Exponent of greatest likelihood, its interval, and the exponent to use: a plain one inside it, or itself.

    Rows are read twice: for the range of the logarithms, and for their moments
    by bucket; the likelihood of any exponent follows from these.
    """
    moments = LogMoments(df, column)
    best = _top(moments.likelihood, -6.0, 6.0)
    floor = moments.likelihood(best) - dist.chi2_isf(alpha, 1) / 2
    ends = []
    for sign in (-1, 1):
        near, far = best, best + sign * 0.5
        while moments.likelihood(far) > floor and abs(far - best) < 64:
            near, far = far, best + (far - best) * 2
        while abs(far - near) > 1e-9:
            middle = (near + far) / 2
            near, far = (middle, far) if moments.likelihood(middle) >= floor else (near, middle)
        ends.append((near + far) / 2)
    plain = [p for p in PLAIN if ends[0] <= p <= ends[1]]
    used = min(plain, key=lambda p: abs(p - best)) if plain else best
    return {"lambda": used, "lambda_mle": best, "ci_low": ends[0], "ci_high": ends[1], "n": moments.n}


def box_cox_transform(df: DataFrame, column: str, alpha: float = 0.05, output: str | None = None) -> tuple[DataFrame, dict]:
    """The frame with the transformed column (missing stays missing), and what :func:`box_cox_lambda` found."""
    found = box_cox_lambda(df, column, alpha)
    x, lam = number(column), found["lambda"]
    return df.withColumn(output or f"{column}_boxcox", F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam), found
