"""Guards on columns, checked on the schema before any job, and the missing-value rule."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALTERNATIVES = ("two-sided", "less", "greater")


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}; there are {', '.join(df.columns)}")


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def require_numeric(df: DataFrame, *columns: str) -> None:
    require(df, *columns)
    other = [c for c in columns if not is_numeric(df, c)]
    if other:
        raise ValueError(f"not numeric: {', '.join(other)}")


def require_alternative(alternative: str) -> None:
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {', '.join(ALTERNATIVES)}")


def number(column: str | Column) -> Column:
    """As a double in which not-a-number is missing too."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(c), c)


def label(df: DataFrame, column: str) -> Column:
    """A group or category, missing where a floating-point label is not a number."""
    c = F.col(column)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else c


def complete(df: DataFrame, by: Iterable[str] = (), labels: dict[str, str] | None = None, **values: str) -> DataFrame:
    """Key columns, ``labels`` and numeric ``values`` under new names; rows with a missing one of the latter two go."""
    labels = labels or {}
    require(df, *by, *labels.values())
    require_numeric(df, *values.values())
    out = df.select(*[F.col(k) for k in by], *[label(df, c).alias(n) for n, c in labels.items()], *[number(c).alias(n) for n, c in values.items()])
    return out.dropna(subset=[*labels, *values]) if labels or values else out


def rounded(c: Column, digits: int = 4) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
