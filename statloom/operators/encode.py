"""Categorical encoders: a small category table, then a row-wise step or a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.columns import label, number, require, require_numeric
from statloom.functions.ordering import row_index

MAX_CATEGORIES = 1000


def _categories(df: DataFrame, column: str, limit: int) -> list:
    require(df, column)
    found = [r["c"] for r in df.select(label(df, column).alias("c")).where("c IS NOT NULL").distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} categories")
    return sorted(found)


def one_hot_encode(df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES, drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each category, sorted, after the other columns; a missing category is all zeros."""
    new = []
    for c in columns:
        for v in _categories(df, c, max_categories)[int(drop_first) :]:
            new.append(F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
    return df.select(*[F.col(c) for c in df.columns if c not in columns], *new)


def dummy_encode(df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """One-hot without the first category of each column."""
    return one_hot_encode(df, columns, max_categories, drop_first=True)


def _coded(df: DataFrame, column: str, codes: DataFrame, out: str) -> DataFrame:
    """Joins a (``_key``, code) table on the category's text; Spark picks the join by the table's size."""
    return df.withColumn("_text", label(df, column).cast("string")).join(codes, F.col("_text") == F.col("_key"), "left").select(*df.columns, F.col("_code").alias(out))


def ordinal_encode(df: DataFrame, column: str, order: Sequence | None = None, output: str | None = None) -> DataFrame:
    """Position of the category in ``order``, or in sorted order of the categories' text; missing stays missing."""
    if order is None:
        return label_encode(df, column, output)
    names = [str(v) for v in order]
    require(df, column)
    text = label(df, column).cast("string")
    other = df.select(text.alias("c")).where(F.col("c").isNotNull() & ~F.col("c").isin(names)).limit(1).collect()
    if other:
        raise ValueError(f"order lacks the category {other[0]['c']!r}")
    codes = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(names)], "_key string, _code int")
    return _coded(df, column, F.broadcast(codes), output or f"{column}_encoded")


def label_encode(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Codes 0 to k-1 in sorted order of the categories' text; missing stays missing."""
    require(df, column)
    names = df.select(label(df, column).cast("string").alias("_key")).where("_key IS NOT NULL").distinct()
    codes = row_index(names, "_key").select("_key", F.col("row_index").cast("int").alias("_code"))
    return _coded(df, column, codes, output or f"{column}_encoded")


def target_encode(df: DataFrame, column: str, target_column: str, smoothing: float = 0.0, output: str | None = None) -> DataFrame:
    """Mean target of the category, drawn to the overall mean by n / (n + smoothing); missing stays missing."""
    require(df, column)
    require_numeric(df, target_column)
    if smoothing < 0:
        raise ValueError("smoothing must not be negative")
    y = number(target_column)
    overall = df.agg(F.avg(y).alias("_all"))
    per = df.groupBy(label(df, column).cast("string").alias("_key")).agg(F.avg(y).alias("_mean"), F.count(y).alias("_n")).where("_key IS NOT NULL")
    share = F.col("_n") / (F.col("_n") + F.lit(float(smoothing)))
    code = F.col("_mean") if smoothing == 0 else F.when(F.col("_n") > 0, share * F.col("_mean") + (1 - share) * F.col("_all")).otherwise(F.col("_all"))
    return _coded(df, column, per.crossJoin(F.broadcast(overall)).select("_key", code.alias("_code")), output or f"{column}_encoded")
