"""Descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.columns import complete, is_numeric, number, require_numeric, rounded
from statloom.functions.ordering import midranks, quantiles


def describe(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles of each numeric column, one row a column, in one job.

    Quartiles interpolate linearly and are exact, from running counts over
    buckets of values; with ``accuracy`` they are approximate, in one pass.
    """
    columns = list(columns) if columns else [c for c in df.columns if is_numeric(df, c)]
    require_numeric(df, *columns)
    q = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    aggs = []
    for i, c in enumerate(columns):
        x = number(c)
        aggs += [f(x).alias(f"{n}_{i}") for n, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
        if accuracy:
            aggs.append(F.percentile_approx(x, q, accuracy).alias(f"q_{i}"))
    one = df.agg(*aggs)
    if not accuracy:
        each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), number(c).cast("double").alias("x")) for i, c in enumerate(columns)])).alias("v"))
        found = quantiles(each.select("v.c", "v.x").where("x IS NOT NULL"), "x", (0.25, 0.5, 0.75), ("c",))
        lists = found.agg(*[F.max(F.when(F.col("c") == i, F.array("q0", "q1", "q2"))).alias(f"q_{i}") for i in range(len(columns))])
        one = one.crossJoin(F.broadcast(lists))
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"count_{i}").alias("count"),
            *[rounded(F.col(f"{n}_{i}")).alias(n) for n in ("mean", "std", "min")],
            *[rounded(F.col(f"q_{i}")[j]).alias(n) for j, n in enumerate(("q25", "q50", "q75"))],
            rounded(F.col(f"max_{i}")).alias("max"),
        )
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*cells)))


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Pairwise-complete correlations of all ordered pairs of columns, rounded to 4 digits."""
    require_numeric(df, *columns)
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be pearson or spearman")
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if method == "pearson":
        one = df.agg(*[F.corr(F.when(number(b).isNotNull(), number(a)), F.when(number(a).isNotNull(), number(b))).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)], *[F.var_pop(number(c)).alias(f"v_{i}") for i, c in enumerate(columns)])
        cells = [F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), rounded(F.col(f"r_{i}")).alias("correlation")) for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
        cells += [F.struct(F.lit(c).alias("column_a"), F.lit(c).alias("column_b"), F.when(F.col(f"v_{i}") > 0, 1.0).alias("correlation")) for i, c in enumerate(columns)]
        return one.select(F.inline(F.array(*cells)))
    filled = df.agg(F.count("*").alias("rows"), *[F.count(number(c)).alias(f"n_{i}") for i, c in enumerate(columns)]).first()
    if all(filled[f"n_{i}"] == filled["rows"] for i in range(len(columns))):  # nothing is missing: each column has one ranking
        ranked = base = df.select(*[number(c).alias(f"_{i}") for i, c in enumerate(columns)])
        for i in range(len(columns)):
            counts = base.groupBy(f"_{i}").agg(F.count("*").alias("_m"))
            ranked = ranked.join(midranks(counts, f"_{i}", "_m").select(f"_{i}", F.col("midrank").alias(f"_r{i}")), f"_{i}")
        return correlation_matrix(ranked.select(*[F.col(f"_r{i}").alias(c) for i, c in enumerate(columns)]), columns)
    out = None
    for a, b in [*pairs, *((c, c) for c in columns)]:
        ranked = rank_pairs(complete(df, x=a, y=b))
        r = ranked.agg(rounded(F.try_divide(F.sum(F.col("n") * F.col("dx") * F.col("dy")), F.sqrt(F.sum(F.col("n") * F.col("dx") ** 2) * F.sum(F.col("n") * F.col("dy") ** 2)))).alias("correlation"))
        both = [(a, b)] if a == b else [(a, b), (b, a)]
        part = r.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b")) for x, y in both])).alias("p"), "correlation").select("p.*", "correlation")
        out = part if out is None else out.unionByName(part)
    return out


def rank_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (x, y) with their count ``n`` and centred midranks ``dx``, ``dy``."""
    counts = pairs.groupBy("x", "y").agg(F.count("*").alias("n"))
    rank = lambda c: midranks(counts.groupBy(c).agg(F.sum("n").alias("m")), c, "m").select(c, F.col("midrank").alias(f"r{c}"))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.join(rank("x"), "x").join(rank("y"), "y").crossJoin(F.broadcast(total))
    middle = (F.col("total") + 1) / 2
    return out.select("n", (F.col("rx") - middle).alias("dx"), (F.col("ry") - middle).alias("dy"), "total")
