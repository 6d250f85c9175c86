"""Rank and contingency tests over tables of distinct values, never over a global sort."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist, tails
from statloom.functions.columns import complete, label, require, require_alternative
from statloom.functions.ordering import midranks
from statloom.operators.describe import rank_pairs
from statloom.operators.parametric import correlation_p

LEAST = 20


@lru_cache(64)
def _mann_whitney_tail(m: int, n: int, most: int) -> float:
    """Share of the orders of two samples without ties whose U is ``most`` or less: coefficients of a Gaussian binomial, up to that one."""
    ways = np.zeros(most + 1, object if m * n <= 20_000 else float)
    ways[0] = 1
    for i in range(1, m + 1):
        if n + i <= most:
            ways[n + i :] = ways[n + i :] - ways[: most + 1 - n - i]
        for start in range(min(i, most + 1)):  # running sums over every i-th
            ways[start::i] = np.cumsum(ways[start::i])
    return float(ways.sum() / math.comb(m + n, m))


def mann_whitney_p(u: float, n1: float, n2: float, ties: float, alternative: str) -> float:
    """Exact where a group has at most 8 values and nothing ties, else normal with tie and continuity correction."""
    big = max(u, n1 * n2 - u) if alternative == "two-sided" else u if alternative == "greater" else n1 * n2 - u
    if min(n1, n2) <= 8 and ties == 0:
        # U and n1 n2 - U are alike, so the upper tail is the lower one of its mirror
        most, all_ = math.floor(n1 * n2 - big + 1e-9), int(n1 * n2)
        p = _mann_whitney_tail(int(min(n1, n2)), int(max(n1, n2)), most) if 2 * most <= all_ else 1 - _mann_whitney_tail(int(min(n1, n2)), int(max(n1, n2)), all_ - most - 1)
    else:
        n = n1 + n2
        sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
        p = dist.norm_sf((big - n1 * n2 / 2 - 0.5) / sd)
    return min(1.0, 2 * p) if alternative == "two-sided" else min(1.0, p)


def mann_whitney_u_test(df: DataFrame, group_col: str, value_col: str, alpha: float = 0.05, alternative: str = "two-sided", groups: Sequence | None = None) -> DataFrame:
    """U of the first of two groups (sorted, or as given)."""
    require_alternative(alternative)
    values = complete(df, labels={"g": group_col}, x=value_col)
    found = [r["g"] for r in values.select("g").distinct().sort("g").limit(3).collect()] if groups is None else list(groups)
    if len(found) != 2:
        raise ValueError("needs exactly two groups")
    first, second = (F.col("g") == F.lit(v) for v in found)
    counts = values.where(first | second).groupBy("x").agg(F.count(F.when(first, 1)).alias("a"), F.count(F.when(second, 1)).alias("b"), F.count("*").alias("n"))
    ranked = midranks(counts, "x", "n")
    t = F.col("n").cast("double")
    s = ranked.agg(F.sum(F.col("midrank") * F.col("a")).alias("r"), F.sum("a").cast("double").alias("n1"), F.sum("b").cast("double").alias("n2"), F.sum(t * t * t - t).alias("ties"))
    out = s.withColumn("u", F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2)
    out = out.withColumn("p_value", dist.column(lambda *v: mann_whitney_p(*v, alternative), *[F.col(c) for c in ("u", "n1", "n2", "ties")]))
    return out.select(F.lit(str(found[0])).alias("group_a"), F.lit(str(found[1])).alias("group_b"), "u", "p_value", F.col("n1").cast("long").alias("n_a"), F.col("n2").cast("long").alias("n_b"), (F.least("n1", "n2") >= LEAST).alias("size_ok"), (F.col("p_value") < alpha).alias("significant"))


@lru_cache(64)
def _signed_rank_counts(n: int) -> tuple[int, ...]:
    ways = [1] + [0] * (n * (n + 1) // 2)
    for i in range(1, n + 1):
        for w in range(len(ways) - 1, i - 1, -1):
            ways[w] += ways[w - i]
    return tuple(ways)


def wilcoxon_p(w: float, n: float, ties: float, zeros: float) -> float:
    """Exact up to 50 pairs without ties or zeros, else normal with tie correction."""
    if n <= 50 and not ties and not zeros:
        ways = _signed_rank_counts(int(n))
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / sum(ways))
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return min(1.0, 2 * dist.norm_sf(abs(w - n * (n + 1) / 4) / sd))


def wilcoxon_signed_rank_test(df: DataFrame, column_a: str, column_b: str, alpha: float = 0.05) -> DataFrame:
    """W, the lesser rank sum of the signed differences of complete pairs; zeros are dropped."""
    d = complete(df, a=column_a, b=column_b).select((F.col("a") - F.col("b")).alias("d"))
    counts = d.groupBy(F.abs("d").alias("x")).agg(F.count(F.when(F.col("d") > 0, 1)).alias("up"), F.count(F.when(F.col("d") < 0, 1)).alias("down"), F.count("*").alias("n"))
    zeros = counts.agg(F.coalesce(F.sum(F.when(F.col("x") == 0, F.col("n"))), F.lit(0)).cast("double").alias("zeros"))
    ranked, t = midranks(counts.where("x > 0"), "x", "n"), F.col("n").cast("double")
    s = ranked.agg(F.sum(F.col("midrank") * F.col("up")).alias("w_plus"), F.sum(F.col("midrank") * F.col("down")).alias("w_minus"), F.sum("n").cast("double").alias("m"), F.sum(t * t * t - t).alias("ties")).crossJoin(zeros)
    out = s.withColumn("w", F.least("w_plus", "w_minus"))
    out = out.withColumn("p_value", dist.column(wilcoxon_p, *[F.col(c) for c in ("w", "m", "ties", "zeros")]))
    return out.select("w", "w_plus", "w_minus", "p_value", F.col("m").cast("long").alias("n_nonzero"), F.col("zeros").cast("long").alias("n_zero"), (F.col("m") + F.col("zeros") >= LEAST).alias("size_ok"), (F.col("p_value") < alpha).alias("significant"))


def kruskal_wallis_test(df: DataFrame, group_col: str, value_col: str, alpha: float = 0.05) -> DataFrame:
    """H with tie correction over all groups."""
    counts = complete(df, labels={"g": group_col}, x=value_col).groupBy("x", "g").agg(F.count("*").alias("c"))
    distinct, t = counts.groupBy("x").agg(F.sum("c").alias("n")), F.col("n").cast("double")
    ranks = midranks(distinct, "x", "n").select("x", "midrank")
    per = counts.join(ranks, "x").groupBy("g").agg(F.sum(F.col("midrank") * F.col("c")).alias("r"), F.sum("c").cast("double").alias("m"))
    s = per.agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("m").alias("total"), F.count("*").cast("double").alias("k"), F.min("m").alias("least"))
    n = F.col("total")
    out = s.crossJoin(distinct.agg(F.sum(t * t * t - t).alias("ties")))
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    out = out.select(h.alias("h"), (F.col("k") - 1).alias("df"), n.cast("long").alias("n"), F.col("k").cast("long").alias("n_groups"), (F.col("least") >= LEAST).alias("size_ok"))
    return out.withColumn("p_value", tails.chi2_sf(F.col("h"), F.col("df"))).withColumn("significant", F.col("p_value") < alpha)


def spearman_correlation_test(df: DataFrame, column_a: str, column_b: str, alpha: float = 0.05) -> DataFrame:
    """Correlation of midranks of complete pairs, with its two-sided p-value."""
    ranked = rank_pairs(complete(df, x=column_a, y=column_b))
    n, dx, dy = F.col("n"), F.col("dx"), F.col("dy")
    out = ranked.agg(F.try_divide(F.sum(n * dx * dy), F.sqrt(F.sum(n * dx * dx) * F.sum(n * dy * dy))).alias("rho"), F.sum("n").alias("n"))
    out = out.withColumn("p_value", correlation_p(F.col("rho"), (F.col("n") - 2).cast("double")))
    return out.withColumn("size_ok", F.col("n") >= LEAST).withColumn("significant", F.col("p_value") < alpha)


def chi_square_test_independence(df: DataFrame, column_a: str, column_b: str, alpha: float = 0.05) -> DataFrame:
    """Chi-square of a contingency table, absent cells included, Yates-corrected at one degree of freedom; Cramer's V.

    The sum over all cells follows from the present ones and the margins; the
    share of small expected counts from how often each margin's size occurs.
    """
    cells = complete(df, labels={"a": column_a, "b": column_b}).groupBy("a", "b").agg(F.count("*").cast("double").alias("o"))
    rows, cols = (cells.groupBy(c).agg(F.sum("o").alias(f"n{c}")) for c in ("a", "b"))
    n = F.col("n")
    size = rows.agg(F.sum("na").alias("n"), F.count("*").cast("double").alias("r"), F.sum(1 / F.col("na")).alias("ia")).crossJoin(cols.agg(F.count("*").cast("double").alias("c"), F.sum(1 / F.col("nb")).alias("ib")))
    e = F.col("na") * F.col("nb") / n
    present = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(size))
    gap = F.col("o") - e
    sums = present.agg(F.sum(gap * gap / e).alias("s"), F.sum(e).alias("covered"), F.max(F.abs(gap)).alias("gap"), *[F.first(c).alias(c) for c in ("n", "r", "c", "ia", "ib")])
    sizes = [t.groupBy(c).agg(F.count("*").cast("double").alias(f"t{c}")) for t, c in ((rows, "na"), (cols, "nb"))]
    few = sizes[0].crossJoin(F.broadcast(size.select("n"))).join(sizes[1], F.col("na") * F.col("nb") / n < 5).agg(F.coalesce(F.sum(F.col("tna") * F.col("tnb")), F.lit(0.0)).alias("few"))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    left = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))  # at one degree of freedom all four cells are as far from what is expected
    chi2 = F.when(dof == 1, left * left * n * F.col("ia") * F.col("ib")).otherwise(F.col("s") + F.greatest(n - F.col("covered"), F.lit(0.0)))
    s = sums.crossJoin(F.broadcast(few)).select(chi2.alias("chi2"), (F.col("few") / (F.col("r") * F.col("c"))).alias("share_below_5"), "n", "r", "c")
    least = F.least("r", "c") - 1
    out = s.select("chi2", dof.alias("df"), F.col("n").cast("long").alias("n"), F.when(least > 0, F.sqrt(F.col("chi2") / (F.col("n") * least))).otherwise(0.0).alias("cramers_v"), "share_below_5", ((F.col("share_below_5") <= 0.2) & (F.col("n") >= LEAST)).alias("assumptions_met"))
    return out.withColumn("p_value", F.when(F.col("df") > 0, tails.chi2_sf(F.col("chi2"), F.col("df"))).otherwise(1.0)).withColumn("significant", F.col("p_value") < alpha)


def chi_square_goodness_of_fit(df: DataFrame, column: str, expected: Sequence[float] | None = None, alpha: float = 0.05) -> DataFrame:
    """Chi-square of category counts against weights (in sorted category order, scaled to the total) or equal shares."""
    require(df, column)
    counts = df.select(label(df, column).alias("c")).where("c IS NOT NULL").groupBy("c").agg(F.count("*").cast("double").alias("o"))
    size = counts.agg(F.count("*").alias("k"), F.sum("o").alias("n"))
    if expected is None:
        terms = counts.withColumn("w", F.lit(1.0)).withColumn("w_total", F.lit(None).cast("double"))
    else:
        found = sorted(r["c"] for r in counts.select("c").limit(len(expected) + 1).collect())
        if len(found) != len(expected):
            raise ValueError("as many weights as categories are needed")
        weights = df.sparkSession.createDataFrame([(i, float(w), float(sum(expected))) for i, w in enumerate(expected)], "i int, w double, w_total double")
        place = F.array_position(F.array(*[F.lit(c) for c in found]), F.col("c")) - 1
        terms = counts.join(F.broadcast(weights), place.cast("int") == F.col("i"))
    e = F.col("w") / F.coalesce("w_total", F.col("k").cast("double")) * F.col("n")
    gap = F.col("o") - e
    out = terms.crossJoin(F.broadcast(size)).agg(F.sum(gap * gap / e).alias("chi2"), F.first("k").alias("k"), F.first("n").alias("n"))
    out = out.select("chi2", (F.col("k") - 1).cast("double").alias("df"), F.col("n").cast("long").alias("n"), (F.col("n") >= LEAST).alias("size_ok"))
    return out.withColumn("p_value", tails.chi2_sf(F.col("chi2"), F.col("df"))).withColumn("significant", F.col("p_value") < alpha)
