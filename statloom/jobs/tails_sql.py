"""Tails of distributions in SQL by Simpson's rule, independent of the library's continued fractions."""

from __future__ import annotations

#: Fixed value: the normal distribution's 97.5 % point.
Z975 = 1.959963984540054
_STEPS = 20_000
_WEIGHT = f"CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def beta_tail(source: str) -> str:
    """``p`` for the rows of ``source`` (id, a, b, x): the incomplete beta function as an integral over an angle."""
    return f"""(SELECT id, 2 * exp(lgamma(any_value(a + b)) - lgamma(any_value(a)) - lgamma(any_value(b))) * sum(w * exp((2 * a - 1) * ln(sin(th)) + (2 * b - 1) * ln(cos(th)))) * any_value(h) / 3 AS p
  FROM (SELECT id, a, b, h, lo + i * h AS th, {_WEIGHT} AS w FROM (SELECT *, (hi - lo) / {_STEPS} AS h FROM (SELECT *, asin(sqrt(x)) AS hi, greatest(1e-9, asin(sqrt(x)) - 40 / sqrt(a + b)) AS lo FROM {source})), (SELECT unnest(range({_STEPS + 1})) AS i)) GROUP BY id)"""


def t_tail(source: str) -> str:
    """Two-sided ``p`` of (id, t, df)."""
    return beta_tail(f"(SELECT id, df / 2.0 AS a, 0.5::DOUBLE AS b, df / (df + t * t) AS x FROM {source})")


def f_tail(source: str) -> str:
    return beta_tail(f"(SELECT id, df2 / 2.0 AS a, df1 / 2.0 AS b, df2 / (df2 + df1 * f) AS x FROM {source})")


def normal_tail(source: str) -> str:
    """Two-sided ``p`` of (id, z)."""
    return f"""(SELECT id, least(1, 2 * sum(w * exp(-u * u / 2)) * 12.0 / {_STEPS} / 3 / sqrt(2 * pi())) AS p FROM (SELECT id, abs(z) + i * 12.0 / {_STEPS} AS u, {_WEIGHT} AS w FROM {source}, (SELECT unnest(range({_STEPS + 1})) AS i)) GROUP BY id)"""


def t_point(df: str) -> str:
    """97.5 % point of Student's t for many degrees of freedom, by its expansion about the normal one."""
    z = Z975
    c = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return f"({z} + {c[0]} / ({df}) + {c[1]} / ({df})^2 + {c[2]} / ({df})^3)"


def normal_cdf(z: str) -> str:
    """Formula 26.2.17 of Abramowitz and Stegun, within 7.5e-8."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"(CASE WHEN {z} >= 0 THEN 1 - exp(-0.5 * power({z}, 2)) / sqrt(2 * pi()) * {poly} ELSE exp(-0.5 * power({z}, 2)) / sqrt(2 * pi()) * {poly} END)"


def range_tail(source: str, groups: int) -> str:
    """``p`` of (id, q, df): the studentised range of ``groups`` means, by sums over a mean and over a deviation."""
    return f"""(SELECT id, 1 - sum(density * inner_sum) / sum(density) AS p FROM
  (SELECT id, s, any_value(density) AS density, {groups} * sum(exp(-z * z / 2) / sqrt(2 * pi()) * power(greatest({normal_cdf('z + q * s')} - {normal_cdf('z')}, 0), {groups - 1})) * 0.05 AS inner_sum
   FROM (SELECT id, q, 1 + u / sqrt(2 * df) AS s, exp((df - 1) * ln(1 + u / sqrt(2 * df)) - df / 2 * ((1 + u / sqrt(2 * df))^2 - 1)) AS density FROM {source}, (SELECT unnest(range(-60, 61)) / 10.0 AS u)),
        (SELECT unnest(range(-160, 161)) * 0.05 AS z) GROUP BY id, s) GROUP BY id)"""
