"""Seasonal-trend decomposition by loess of series of any length.

Every step of the decomposition looks a bounded number of periods around a
place, so a block of a series that borrows enough rows from both neighbours
gives its own rows exactly as the whole series would.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.ordering import blocks
from statloom.functions.scratch import written
from statloom.operators.stationarity import ordered_series

SEASONAL, ROUNDS = 7, 5
#: Own rows of a block, at least.
LEAST_ROWS = 8192


def spans(period: int) -> tuple[int, int]:
    """Fixed rule of the method: odd spans of trend and low-pass smoothing."""
    trend = math.ceil(1.5 * period / (1 - 1.5 / SEASONAL))
    return trend + 1 - trend % 2, period + 1 + period % 2


def reach(period: int) -> int:
    """Rows around a place that all rounds together look at, in whole periods.

    A round reaches three periods and one more at ends by the seasonal
    smoothing, one by the moving averages and half of both other spans; twice
    the latter at an end of the block.
    """
    trend, low = spans(period)
    return period * math.ceil(ROUNDS * (8 * period + period + 2 + trend + low) / period)


def _weights(gap: np.ndarray, h) -> np.ndarray:
    w = np.where(gap < 0.999 * h, (1 - np.minimum(gap / h, 1) ** 3) ** 3, 0)
    return np.where(gap < 0.001 * h, 1.0, w)


def loess(y: np.ndarray, span: int, at: np.ndarray | None = None) -> np.ndarray:
    """Locally linear tricube fits of an evenly spaced series, at all of its places or at given ones.

    Where a window lies evenly around its place the fit is a weighted mean with
    the same weights everywhere, hence a convolution.
    """
    n = len(y)
    q = min(span, n)
    half = q // 2
    if at is None and q % 2 and q == span and n > 2 * half:
        gap = np.abs(np.arange(-half, half + 1.0))
        w = _weights(gap, max(half, 1e-12))
        w /= w.sum()
        if q > 64:
            size = 1 << (n + q - 1).bit_length()
            centre = np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(w, size), size)[q - 1 : n]
        else:
            centre = np.convolve(y, w, "valid")
        places = np.arange(n, dtype=float)
        return np.concatenate([loess(y, span, places[:half]), centre, loess(y, span, places[n - half :])])
    at = np.arange(n, dtype=float) if at is None else at
    out, step = np.empty(len(at)), max(1, (1 << 21) // q)
    for a in range(0, len(at), step):
        place = at[a : a + step]
        first = np.clip(np.round(place).astype(int) - half, 0, n - q)
        x = first[:, None] + np.arange(q)
        u = x - place[:, None]
        gap = np.abs(u)
        h = np.maximum(gap.max(1), 1e-12) + max(span - n, 0) / 2
        w = _weights(gap, h[:, None])
        w /= w.sum(1, keepdims=True)
        mean = (w * u).sum(1)
        off = u - mean[:, None]
        spread = (w * off**2).sum(1)
        slope = np.where(spread > 1e-12, (w * off * y[x]).sum(1) / np.maximum(spread, 1e-12), 0)
        out[a : a + step] = (w * y[x]).sum(1) - slope * mean
    return out


def _average(y: np.ndarray, k: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(y)])
    return (total[k:] - total[:-k]) / k


def stl(y: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend parts of consecutive rows, not robust."""
    n = len(y)
    trend_span, low_span = spans(period)
    trend = np.zeros(n)
    for _ in range(ROUNDS):
        flat, cycle = y - trend, np.zeros(n + 2 * period)
        for s in range(period):
            part = flat[s::period]
            cycle[s::period][: len(part) + 2] = np.concatenate([loess(part, SEASONAL, np.array([-1.0])), loess(part, SEASONAL), loess(part, SEASONAL, np.array([float(len(part))]))])
        low = _average(_average(_average(cycle, period), period), 3)
        season = cycle[period : period + n] - loess(low, low_span)
        trend = loess(y - season, trend_span)
    return season, trend


def decompose_time_series(df: DataFrame, key: str, order_by: str, value: str, period: int) -> DataFrame:
    """Observed, trend, seasonal and residual of every series of two periods or more, and both strengths."""
    if period < 2:
        raise ValueError("period must be 2 or more")
    rows = ordered_series(df, key, order_by, value).where(F.col("n") >= 2 * period)
    around = reach(period)
    size = period * math.ceil(max(LEAST_ROWS, around) / period)
    kinds = dict(rows.dtypes)

    def parts(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                series, block, first = (batch.column(c)[i].as_py() for c in (0, 2, 3))
                at, y = batch.column(4)[i].values, batch.column(5)[i].values.to_numpy(zero_copy_only=False)
                # values are shifted to the block's mean, which a local fit follows
                season, trend = stl(y - y.mean(), period)
                own = slice(block * size - first, (block + 1) * size - first)
                y, season, trend = y[own], season[own], trend[own] + y.mean()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * len(y))), at[own.start : own.start + len(y)], *[pa.array(c) for c in (y, trend, season, y - season - trend)]], ["series", "at", "observed", "trend", "seasonal", "residual"]
                )

    cut = blocks(rows, ["series", "n"], ["at", "y"], size, around, around)
    out = written(cut.mapInArrow(parts, f"series {kinds['series']}, at {kinds['at']}, observed double, trend double, seasonal double, residual double"), "parts")
    left = F.var_samp("residual")
    strength = lambda part: F.greatest(F.lit(0.0), F.coalesce(1 - F.try_divide(left, F.var_samp(F.col("residual") + F.col(part))), F.lit(0.0)))
    strengths = out.groupBy(F.col("series").alias("_s")).agg(strength("trend").alias("trend_strength"), strength("seasonal").alias("seasonal_strength"))
    return out.join(strengths, F.col("series").eqNullSafe(F.col("_s"))).drop("_s")
