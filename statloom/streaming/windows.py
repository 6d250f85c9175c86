"""Running statistics of a stream: the moments of the tests, by event-time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.columns import number, require, require_numeric


def windowed_moments(stream: DataFrame, time_col: str, value_col: str, by: Sequence[str] = (), window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Count, mean, deviation, skewness and kurtosis of a value in each window and group.

    Works on streams and tables alike; on a stream, windows close once the
    watermark has passed them, and later rows are not counted. Rows with a
    missing time or value are not counted either.
    """
    require(stream, time_col, *by)
    require_numeric(stream, value_col)
    rows = stream.select(F.col(time_col).alias("at"), *by, number(value_col).alias("x")).where("at IS NOT NULL AND x IS NOT NULL")
    per = rows.withWatermark("at", lateness).groupBy(F.window("at", window).alias("w"), *by)
    out = per.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "mean", "sd", "skewness", "kurtosis")
