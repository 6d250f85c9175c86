"""Assumption checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist, tails
from statloom.functions.columns import complete
from statloom.functions.ordering import quantiles, with_lag

#: From this many values on normality is judged by moments, below by order statistics.
MOMENTS_FROM = 5000
LEVEL = 0.05


#: Rows that each kind of test asks for; regressions ask for ten a predictor.
LEAST_ROWS = {"means": 30, "ranks": 20, "resampling": 10, "stationarity": 30}


def sample_size_check(n: Column, least: int) -> Column:
    return n >= least


def sample_sizes(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Values of a column, by key, and whether they are enough for each kind of test."""
    out = complete(df, by, x=column).groupBy(*by).agg(F.count("x").alias("n"))
    return out.select(*by, "n", *[sample_size_check(F.col("n"), least).alias(f"enough_for_{name}") for name, least in LEAST_ROWS.items()])


def _k2(g1: Column, g2: Column, n: Column) -> Column:
    """D'Agostino-Pearson K2 from population skewness, excess kurtosis and count."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(var)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    z2 = ((1 - 2 / (9 * a)) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value by Royston's approximation, for 3 to 4999 values."""
    x, n = np.sort(values), len(values)
    x = x - x.mean()
    if x[-1] == x[0]:
        return 1.0, 1.0
    m = np.array([-dist.norm_isf((i - 0.375) / (n + 0.25)) for i in range(1, n // 2 + 1)])
    m = np.concatenate([m, np.zeros(n % 2), -m[::-1]])
    m2, u = m @ m, 1 / math.sqrt(n)
    a = m / math.sqrt(m2)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        last = a[-1] + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)
        if n > 5:
            second = a[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
            phi = (m2 - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            a = m / math.sqrt((m2 - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = min((a @ x) ** 2 / (x @ x), 1.0)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1:
        return w, 1.0
    log = math.log(n)
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if math.log(1 - w) >= gamma:
            return w, 0.0
        y = -math.log(gamma - math.log(1 - w))
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y = math.log(1 - w)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log))
    return w, dist.norm_sf((y - mean) / sd)


def normality_check(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., n, test, statistic, p_value, passed)``: one row a group.

    Groups of 5000 values or more are judged by K2, from one aggregate. Only
    smaller groups are sent whole to a task, for Shapiro-Wilk. Fewer than three
    values fail without a statistic; a constant group of 5000 has none either.
    """
    by = list(by)
    values = complete(df, by, x=column)
    n = F.col("n").cast("double")
    per = values.groupBy(*by).agg(F.count("x").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"))
    k2 = F.when(n >= MOMENTS_FROM, _k2(F.col("g1"), F.col("g2"), n))
    few = per.where((F.col("n") >= 3) & (F.col("n") < MOMENTS_FROM)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.lit(1).alias("_small"))
    tagged = values.select(*[F.col(k).alias(f"_v{i}") for i, k in enumerate(by)], "x")
    on = [F.col(f"_v{i}").eqNullSafe(F.col(f"_k{i}")) for i in range(len(by))]
    small = tagged.join(few, on) if by else tagged.crossJoin(F.broadcast(few))
    keys = [f"_v{i}" for i in range(len(by))]
    fields = "".join(f"{k} {t}, " for k, t in tagged.select(*keys).dtypes) if by else ""

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["x"].to_numpy())
        return pd.DataFrame([(*key[: len(by)], float(w), float(p))], columns=[*keys, "w", "p"])

    judged = small.groupBy(*(keys or ["_small"])).applyInPandas(kernel, f"{fields}w double, p double")
    on = [per[k].eqNullSafe(judged[f"_v{i}"]) for i, k in enumerate(by)] or F.lit(True)
    both = per.join(judged, on, "left")
    p_value = F.when(n >= MOMENTS_FROM, F.exp(-k2 / 2)).otherwise(F.col("p"))
    return both.select(
        *[per[k] for k in by],
        "n",
        F.when(n >= MOMENTS_FROM, "dagostino_pearson").when(n >= 3, "shapiro_wilk").alias("test"),
        F.when(n >= MOMENTS_FROM, k2).otherwise(F.col("w")).alias("statistic"),
        p_value.alias("p_value"),
        F.coalesce(p_value > LEVEL, F.lit(False)).alias("passed"),
    )


def distances_anova(values: DataFrame) -> DataFrame:
    """F of the distances of ``x`` from the medians of the groups ``g``, without its tail: ``f, df1, df2``."""
    medians = quantiles(values, "x", (0.5,), ("g",)).withColumnRenamed("q0", "m")
    z = values.join(medians, "g").withColumn("z", F.abs(F.col("x") - F.col("m")))
    return anova_of(z.groupBy("g").agg(F.count("z").cast("double").alias("n"), F.avg("z").alias("mean"), F.var_pop("z").alias("var"))).select("f", "df1", "df2")


def homogeneity_of_variance(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """Brown-Forsythe: one-way F of the distances from the groups' medians; one row."""
    out = distances_anova(complete(df, labels={"g": group_col}, x=value_col))
    out = out.select(F.col("f").alias("statistic"), "df1", "df2", tails.f_sf(F.col("f"), F.col("df1"), F.col("df2")).alias("p_value"))
    return out.withColumn("passed", F.col("p_value") > LEVEL)


def anova_of(groups: DataFrame) -> DataFrame:
    """F, degrees of freedom and eta squared from one row (n, mean, var_pop) a group; the tail is the caller's, after all joins, as its expression is long."""
    grand = groups.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    gap = F.col("mean") - F.col("grand")
    total = groups.crossJoin(F.broadcast(grand)).agg(
        F.count("*").cast("double").alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.coalesce(F.sum(F.col("n") * gap * gap), F.lit(0.0)).alias("between"),
    )
    df1, df2 = F.col("k") - 1, F.col("total") - F.col("k")
    out = total.select("k", "total", "within", "between", df1.alias("df1"), df2.alias("df2"))
    f = F.try_divide(F.col("between") / F.col("df1"), F.col("within") / F.col("df2"))
    eta = F.coalesce(F.try_divide(F.col("between"), F.col("between") + F.col("within")), F.lit(0.0))
    return out.withColumns({"f": f, "eta_squared": eta})


def durbin_watson(df: DataFrame, residual: str, order_by: str) -> DataFrame:
    """Sum of squared steps of the residuals in order over their sum of squares; passed from 1.5 to 2.5."""
    rows = with_lag(complete(df.select(order_by, residual), (order_by,), e=residual), order_by, "e")
    stat = rows.agg(F.try_divide(F.sum((F.col("e") - F.col("lagged")) ** 2), F.sum(F.col("e") ** 2)).alias("statistic"))
    return stat.withColumn("passed", F.col("statistic").between(1.5, 2.5))
