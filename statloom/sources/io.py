"""Reading, writing and profiling of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_TYPES = ("csv", "tsv", "json", "jsonl", "parquet")


def read_dataset(spark: SparkSession, path: str, file_type: str | None = None) -> DataFrame:
    """A dataset by its extension or ``file_type``; a top-level JSON array gives a row for each record."""
    kind = (file_type or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind not in FILE_TYPES:
        raise ValueError(f"unknown file type {kind!r}; known are {', '.join(FILE_TYPES)}")
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="," if kind == "csv" else "\t")
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.json(path, multiLine=kind == "json")


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def preview(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows, by ``order_by`` where an order is wanted."""
    return (df.orderBy(order_by) if order_by else df).limit(n)


def profile_dataset(df: DataFrame) -> DataFrame:
    """One row a column: its place, name, type, and the numbers of rows and of values in it."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"_{i}").alias("n_values"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return counts.select("n_rows", F.inline(cells)).select("position", "column", "type", "n_rows", "n_values")
