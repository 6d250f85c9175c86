"""Exact splits by a global row index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.columns import require
from statloom.functions.ordering import row_index


def _labelled(df: DataFrame, order_by: str, cuts: list[tuple[str, float]], shuffle: bool, seed: int) -> DataFrame:
    require(df, order_by)
    rows = df
    if shuffle:
        rows = df.withColumn("_md5", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(order_by).cast("string"))))
        indexed = row_index(rows, "_md5")
    else:
        indexed = row_index(rows, order_by)
    n = df.count()
    ends = [(name, int(n * share)) for name, share in cuts]
    sizes = [b - a for a, b in zip([0, *[e for _, e in ends[:-1]]], [e for _, e in ends])]
    if min(sizes) == 0:
        raise ValueError("a part of the split would be empty")
    part = F.when(F.col("row_index") < ends[0][1], ends[0][0])
    for name, end in ends[1:]:
        part = part.when(F.col("row_index") < end, name)
    return indexed.withColumn("split", part).drop("_md5")


def train_test_split(df: DataFrame, order_by: str, test_size: float = 0.2, random_state: int = 0, shuffle: bool = False) -> DataFrame:
    """Adds ``row_index`` and ``split``: train up to row int(n * (1 - test_size)), then test.

    Rows go in order of the unique ``order_by``, or of md5(seed|key) if shuffled.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    return _labelled(df, order_by, [("train", 1 - test_size), ("test", 1.0)], shuffle, random_state)


def train_validation_test_split(df: DataFrame, order_by: str, validation_size: float = 0.1, test_size: float = 0.2, random_state: int = 0, shuffle: bool = False) -> DataFrame:
    """Three parts, cut at int(n * (1 - v - t)) and int(n * (1 - t))."""
    if not (0 < validation_size < 1 and 0 < test_size < 1 and validation_size + test_size < 1):
        raise ValueError("sizes must lie between 0 and 1 and sum to less than 1")
    return _labelled(df, order_by, [("train", 1 - validation_size - test_size), ("validation", 1 - test_size), ("test", 1.0)], shuffle, random_state)
