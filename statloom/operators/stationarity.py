"""Tests for a unit root and for stationarity of series of any length.

A series is cut into blocks of consecutive places; each block borrows from the
one before it the values that lags reach back to. Blocks give sums of lagged
products and of running sums; those of a series add up to the cross-products
of every lag order, so that only a few numbers a lag meet at a series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.columns import number, require, require_numeric
from statloom.functions.ordering import blocks, placed
from statloom.functions.scratch import written

BLOCK = 8192


def ordered_series(df: DataFrame, key: str, order_by: str, value: str) -> DataFrame:
    """``series, at, y, place, n, mean, min_y, max_y`` of the values that are not missing; ``order_by`` is unique in a series."""
    require(df, key, order_by)
    require_numeric(df, value)
    rows = df.select(F.col(key).alias("series"), F.col(order_by).alias("at"), number(value).alias("y")).where("y IS NOT NULL")
    out = placed(rows, ["at"], ["series"], {"total": F.col("y"), "min_y": F.col("y"), "max_y": F.col("y")})
    return out.withColumn("mean", F.col("total") / F.col("n")).drop("total")


def _most_lags(n):
    """The longest lag order that is tried."""
    return F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(n / 100, 0.25)), F.floor(n / 2) - 2)).cast("long")


#: Kinds of sums: by lag, by block, values at the start, values at the end.
LAG, BLOCK_SUMS, HEAD, TAIL = range(4)
SUMS = "n long, most long, kind int, i long, a double, b double, c double"


def _block_sums(e: np.ndarray, first: int, block: int, n: int, most: int) -> list[tuple]:
    """Of one block of deviations from the mean: (kind, i, a, b, c)."""
    lead = block * BLOCK - first
    own = e[lead:]
    run = np.cumsum(own)
    out = [(BLOCK_SUMS, block, own.sum(), run.sum(), float(run @ run))]
    d = np.diff(e)  # d[j] ends at value j + 1
    begin = max(lead, 1)  # the first own value that has one before it
    ends = np.arange(begin, len(e))
    fits = ends[ends + first >= most + 1]
    for k in range(most + 1):
        own_d = ends[ends - 1 - k >= 0]
        lagged = float(d[own_d - 1] @ d[own_d - 1 - k])
        crossed = float(e[fits - 1] @ d[fits - 1 - k])
        same = np.arange(max(lead, k), len(e))
        out.append((LAG, k, lagged, crossed, float(e[same] @ e[same - k])))
    places = np.arange(lead, len(e)) + first
    out += [(HEAD, int(p), float(v), 0.0, 0.0) for p, v in zip(places[places <= most], own)]
    late = places >= n - 1 - most
    return out + [(TAIL, int(p), float(v), 0.0, 0.0) for p, v in zip(places[late], own[late])]


def _eliminated(g: np.ndarray, order) -> np.ndarray:
    """Cross-products after the variables of ``order`` are regressed out; collinear ones change nothing."""
    g = g.copy()
    scale = np.diag(g).copy()
    for i in order:
        if g[i, i] > 1e-12 * scale[i] > 0:
            g = g - np.outer(g[:, i], g[i]) / g[i, i]
    return g


def unit_root(n: int, most: int, lagged: np.ndarray, crossed: np.ndarray, squares: float, head: np.ndarray, tail: np.ndarray) -> tuple[float, float, int, float]:
    """Augmented Dickey-Fuller with a constant from sums over a series: statistic, MacKinnon p-value, lag by AIC, that AIC.

    ``head`` and ``tail`` are the first and last ``most + 1`` deviations.
    Variables: constant, level, change, changes 1 to ``most`` before.
    """
    last = n - 2  # the last change
    hd, td = np.diff(head), np.diff(tail)[::-1]  # hd[u] = d_u; td[i] = d_(last - i)
    m = most
    p = np.zeros((m + 1, m + 1))
    p[0] = [lagged[j] - hd[j:m] @ hd[: m - j] for j in range(m + 1)]
    for i in range(m):
        p[i + 1, i + 1 :] = p[i, i:m] + hd[m - 1 - i] * hd[m - 1 - i :: -1][: m - i] - td[i] * td[i:m]
    p = np.triu(p) + np.triu(p, 1).T
    rows = last - m + 1
    g = np.zeros((m + 3, m + 3))
    g[0, 0] = rows
    g[0, 1] = g[1, 0] = -(head[:m].sum() + tail[-1])
    g[1, 1] = squares - head[:m] @ head[:m] - tail[-1] ** 2
    g[0, 2:] = g[2:, 0] = [tail[len(tail) - 1 - k] - head[m - k] for k in range(m + 1)]
    g[1, 2:] = g[2:, 1] = crossed
    g[2:, 2:] = p

    work, best, lag = _eliminated(g, [0, 1]), math.inf, 0
    for k in range(m + 1):
        if k:
            work = _eliminated(work, [2 + k])
        aic = rows * (math.log(2 * math.pi * max(work[2, 2], 1e-300) / rows) + 1) + 2 * (k + 2)
        if aic < best:
            best, lag = aic, k
    pick = [0, 1, *range(2, 3 + lag)]
    g = g[np.ix_(pick, pick)]
    for t in range(lag, m):  # rows that only the longer lags had to leave out
        x = np.array([1.0, head[t], *hd[t - lag : t + 1][::-1]])
        g += np.outer(x, x)
    g = _eliminated(g, [0, *range(3, 3 + lag)])
    beta = g[1, 2] / g[1, 1]
    rest = max(g[2, 2] - beta * g[1, 2], 0.0)
    tau = beta / math.sqrt(rest / (last - lag + 1 - lag - 2) / g[1, 1])
    return tau, mackinnon_p(tau), lag, best


def mackinnon_p(tau: float) -> float:
    """Response surface of MacKinnon (1994) for one series with a constant."""
    if tau > 2.74 or tau < -18.83:
        return float(tau > 0)
    poly = [0.038269, 1.4412, 2.1659] if tau <= -1.61 else [-0.010368, -0.12745, 0.93202, 1.7339]
    return dist.norm_cdf(float(np.polyval(poly, tau)))


def bandwidth(n: int, products: np.ndarray) -> int:
    """Lags of the long-run variance by Hobijn, Franses and Ooms (1998), Bartlett weights."""
    s0, s1 = products[0] / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        c = products[i] / (n / 2)
        s0, s1 = s0 + c, s1 + i * c
    return min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)


def _moving_squares(e: np.ndarray, lead: int, reach: int, is_last: bool) -> float:
    """Squares of the sums of ``reach`` + 1 values that end at each own value, and after the last one."""
    total = np.concatenate([[0.0], np.cumsum(e)])
    ends = np.arange(lead, len(e) + (reach if is_last else 0))
    window = total[np.minimum(ends + 1, len(e))] - total[np.maximum(ends - reach, 0)]
    return float(window @ window)


RESULT = "n long, adf double, adf_p double, adf_lags int, adf_aic double, kpss_lags int, path double"


def check_stationarity(df: DataFrame, key: str, order_by: str, value: str, alpha: float = 0.05) -> DataFrame:
    """ADF and KPSS of every series; ``agree`` where both say the same. Series under 12 values or constant have no figures.

    One pass over blocks gives the sums of all lag orders, a second the
    long-run variance at the bandwidth that the first has led to; sums of
    moving sums stand in for a product a lag.
    """
    rows = ordered_series(df, key, order_by, value)
    kind = dict(rows.dtypes)["series"]
    fit = rows.where("n >= 12 AND max_y > min_y").withColumn("most", _most_lags(F.col("n"))).drop("at", "min_y", "max_y")

    def sums(batches):
        for batch in batches:
            series, out = batch.column(0), {"row": [], "n": [], "most": [], "cells": []}
            for r, (n, mean, most, block, first, values) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 6)), batch.column(6))):
                got = _block_sums(values.values.to_numpy() - mean, first, block, n, most)
                out["row"] += [r] * len(got)
                out["n"] += [n] * len(got)
                out["most"] += [most] * len(got)
                out["cells"] += got
            if out["row"]:
                cells = list(zip(*out["cells"]))
                yield pa.RecordBatch.from_arrays([series.take(pa.array(out["row"])), pa.array(out["n"]), pa.array(out["most"]), pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cells[2:]]], ["series", "n", "most", "kind", "i", "a", "b", "c"])

    cut = blocks(fit, ["series", "n", "mean", "most"], ["y"], BLOCK, F.col("most") + 1)
    table = written(cut.mapInArrow(sums, f"series {kind}, {SUMS}"), "lag-sums")
    by = ["series", "n", "most", "kind"]
    added = table.where(f"kind <> {BLOCK_SUMS}").groupBy(*by, "i").agg(*[F.sum(c).alias(c) for c in "abc"])
    before = F.coalesce(F.sum("a").over(W.partitionBy("series").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    length = F.least(F.lit(BLOCK), F.col("n") - F.col("i") * BLOCK)
    path = table.where(f"kind = {BLOCK_SUMS}").select(*by, (F.col("c") + 2 * before * F.col("b") + length * before * before).alias("a"))
    path = path.groupBy(*by).agg(F.sum("a").alias("a")).select(*by, F.lit(0).cast("long").alias("i"), "a", F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))

    def solve(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, most = int(pdf["n"].iloc[0]), int(pdf["most"].iloc[0])
        part = {k: g.sort_values("i") for k, g in pdf.groupby("kind")}
        lags = part[LAG]
        tau, p, lag, aic = unit_root(n, most, lags["a"].to_numpy(), lags["b"].to_numpy(), float(lags["c"].iloc[0]), part[HEAD]["a"].to_numpy(), part[TAIL]["a"].to_numpy())
        row = (group[0], n, tau, p, lag, aic, bandwidth(n, lags["c"].to_numpy()), float(part[BLOCK_SUMS]["a"].iloc[0]))
        return pd.DataFrame([row], columns=["series", *(c.split()[0] for c in RESULT.split(", "))])

    solved = written(added.unionByName(path).groupBy("series").applyInPandas(solve, f"series {kind}, {RESULT}"), "unit-roots")

    def squares(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(1, 6)), batch.column(6))
            got = [_moving_squares(v.values.to_numpy() - mean, block * max(BLOCK, reach) - first, reach, (block + 1) * max(BLOCK, reach) >= n) for n, mean, reach, block, first, v in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["series", "squares"])

    reach = solved.select(F.col("series").alias("_s"), F.col("kpss_lags").cast("long").alias("reach"))
    again = fit.join(reach, F.col("series").eqNullSafe(F.col("_s"))).select("series", "n", "mean", "reach", "place", "y")
    moved = blocks(again, ["series", "n", "mean", "reach"], ["y"], F.greatest(F.lit(BLOCK), "reach"), F.col("reach"))
    varied = moved.mapInArrow(squares, f"series {kind}, squares double").groupBy(F.col("series").alias("_s")).agg(F.sum("squares").alias("squares"))
    statistic = F.col("path") / F.col("n") / (F.col("squares") / (F.col("kpss_lags") + 1))
    found = solved.join(varied, F.col("series").eqNullSafe(F.col("_s"))).withColumn("kpss", statistic)
    every = rows.groupBy(F.col("series").alias("_all")).agg(F.count("*").alias("_n"))
    out = every.join(found, F.col("series").eqNullSafe(F.col("_all")) & F.col("adf").isNotNull(), "left").select(F.col("_all").alias("series"), F.col("_n").alias("n"), "adf", "adf_p", "adf_lags", "adf_aic", "kpss", kpss_p(F.col("kpss")).alias("kpss_p"), "kpss_lags")
    stationary = (F.col("adf_p") < alpha, F.col("kpss_p") >= alpha)
    return out.withColumns({"adf_stationary": stationary[0], "kpss_stationary": stationary[1], "agree": stationary[0] == stationary[1], "size_ok": F.col("n") >= 30, "recommended_alternative": F.when(~stationary[0], "decompose_time_series")})


def kpss_p(statistic):
    """Critical values of Kwiatkowski and others (1992) around a constant; between them a straight line, 0.01 to 0.1."""
    points = [(0.347, 0.1), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
    p = F.lit(points[-1][1])
    for (x0, p0), (x1, p1) in reversed(list(zip(points, points[1:]))):
        p = F.when(statistic < x1, p0 + (statistic - x0) / (x1 - x0) * (p1 - p0)).otherwise(p)
    return F.when(statistic <= points[0][0], F.lit(points[0][1])).when(statistic.isNotNull(), p)
