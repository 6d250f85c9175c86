"""Global order without a global sort in one task.

Rows are range partitioned by sampled bounds of the order itself and written
in order, once. A group's rows in a partition follow each other there, so that
one row for each group and partition is all that is summed up in order; windows
run inside a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.functions.scratch import written


def _ordered(df: DataFrame, order: Sequence[str], by: Sequence[str], cells: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """The rows in a table with ``cells``, their partition ``_part`` and a number ``_row`` that rises along the order; and the key columns' names.

    Keys may be of any type; texts with a common beginning spread evenly.
    Missing keys are a group, and come first.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    wide = df.withColumns({**{k: F.col(c) for k, c in zip(keys, by)}, **cells, "_all": F.lit(True)})
    along = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    rows = wide.repartitionByRange(*along).sortWithinPartitions(*along)
    return written(rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ordered"), [*keys, "_all"]


def _with_parts(rows: DataFrame, keys: list[str], aggs: list[Column], starts: list[Column]) -> DataFrame:
    """Joins to each row what ``starts`` makes of its group's partitions, one row each; the join is on group and partition, so no group is hot."""
    runs = rows.groupBy(*keys, "_part").agg(*aggs).select(*[F.col(k).alias(f"_j{k}") for k in (*keys, "_part")], *starts)
    on = [rows[k].eqNullSafe(F.col(f"_j{k}")) for k in keys] + [rows["_part"] == F.col("_j_part")]
    return rows.join(runs, on)


def _earlier(keys: list[str]):
    return W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def running(df: DataFrame, order: Sequence[str], sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Adds for each of ``sums`` its total over the rows before this one, in ``order``, unique within ``by``."""
    rows, keys = _ordered(df.withColumns(sums), order, by, {})
    joined = _with_parts(rows, keys, [F.sum(n).alias(f"_t_{n}") for n in sums], [F.coalesce(F.sum(f"_t_{n}").over(_earlier(keys)), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inside = W.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    out = joined.withColumns({f"before_{n}": F.col(f"_s_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums})
    return out.select(*df.columns, *[n for n in sums if n not in df.columns], *[f"before_{n}" for n in sums])


def placed(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), totals: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``place`` (from 0, in ``order`` within ``by``), ``n`` (rows of ``by``) and ``totals`` of ``by``: sums, or minima and maxima by the first word of the name."""
    totals = totals or {}
    rows, keys = _ordered(df, order, by, {f"_v_{name}": c for name, c in totals.items()})
    fold = {name: {"min": F.min, "max": F.max}.get(name.split("_")[0], F.sum) for name in totals}
    whole = W.partitionBy(*keys)
    joined = _with_parts(
        rows, keys, [F.min("_row").alias("_first"), F.count("*").alias("_m"), *[fold[t](f"_v_{t}").alias(f"_t_{t}") for t in totals]],
        ["_first", F.coalesce(F.sum("_m").over(_earlier(keys)), F.lit(0)).alias("_start"), F.sum("_m").over(whole).alias("n"), *[fold[t](f"_t_{t}").over(whole).alias(t) for t in totals]],
    )
    return joined.withColumn("place", F.col("_start") + F.col("_row") - F.col("_first")).select(*df.columns, "place", "n", *totals)


def quantiles(values: DataFrame, x: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``q0, q1, ...``: exact quantiles of a number, linearly interpolated, one row a group of ``by``.

    Equal values combine before the shuffle, and counts are run along the
    partitions, so that no task sees all values of a column or of a hot group.
    """
    counts = written(values.groupBy(*by, x).agg(F.count("*").alias("_m")), "counts")
    ranked = running(counts, [x], {"_n": F.col("_m")}, by)
    totals = counts.groupBy(*by).agg(F.sum("_m").alias("_total"))
    joined = ranked.join(totals, list(by)) if by else ranked.crossJoin(F.broadcast(totals))
    aggs, cells = [], []
    for i, share in enumerate(shares):
        h = F.lit(float(share)) * (F.col("_total") - 1)
        at = lambda rank: F.max(F.when((rank >= F.col("before__n")) & (rank < F.col("before__n") + F.col("_m")), F.col(x)))
        aggs += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}")]
        cells.append((F.col(f"_lo{i}") + (h - F.floor(h)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}"))
    return joined.groupBy(*by).agg(F.max("_total").alias("_total"), *aggs).select(*by, *cells)


def row_index(df: DataFrame, order_by: str) -> DataFrame:
    """Adds ``row_index``, from 0, in the order of a unique column of any type."""
    return placed(df, [order_by]).withColumnRenamed("place", "row_index").select(*df.columns, "row_index")


#: Rows in which a row finds the one before it without a look beyond.
_BLOCK = 8192


def with_lag(df: DataFrame, order_by: str, value: str) -> DataFrame:
    """Adds ``lagged``: ``value`` of the row before; the first of a block takes it from the block before."""
    rows = placed(df, [order_by]).withColumn("_block", F.floor(F.col("place") / _BLOCK))
    ends = rows.where((F.col("place") + 1) % _BLOCK == 0).select((F.col("_block") + 1).alias("_block"), F.col(value).alias("_previous"))
    before = F.lag(value).over(W.partitionBy("_block").orderBy("place"))
    return rows.join(ends, "_block", "left").withColumn("lagged", F.when(F.col("place") % _BLOCK == 0, F.col("_previous")).otherwise(before)).select(*df.columns, "lagged")


def midranks(counts: DataFrame, value: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``midrank`` to a table of distinct values with their counts."""
    return running(counts, [value], {"_n": F.col(n)}, by).withColumn("midrank", F.col("before__n") + (F.col(n) + 1) / 2).drop("before__n", "_n")


def blocks(rows: DataFrame, by: Sequence[str], values: Sequence[str], size: Column | int, before: Column | int = 0, after: Column | int = 0) -> DataFrame:
    """Rows of :func:`placed` in blocks of ``size`` places: ``by, block, first`` and an array for each of ``values``, in order.

    A block also holds up to ``before`` rows that precede it and ``after``
    that follow it, lent by its neighbours; ``first`` is the place of the first
    row in it. ``size`` must not be less than ``before`` or ``after``; all
    three may differ from series to series. Columns of ``by`` must be the same
    for all rows of a series.
    """
    size, before, after = (c if isinstance(c, Column) else F.lit(c) for c in (size, before, after))
    at, own = F.pmod("place", size), F.floor(F.col("place") / size)
    homes = F.array_compact(F.array(own, F.when((at >= size - before) & ((own + 1) * size < F.col("n")), own + 1), F.when((at < after) & (own > 0), own - 1)))
    lent = rows.select(*by, F.explode(homes).alias("block"), F.struct("place", *values).alias("_row"))
    gathered = lent.groupBy(*by, "block").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    return gathered.select(*by, "block", F.col("_rows")[0]["place"].alias("first"), *[F.col(f"_rows.{c}").alias(c) for c in values])
