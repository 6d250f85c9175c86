"""Parametric tests: one aggregate each, then arithmetic on a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist, tails
from statloom.functions.columns import complete, require_alternative, require_numeric, number
from statloom.operators.checks import LEVEL, anova_of, distances_anova, normality_check

LARGE = 30


def _moments(x: str = "x") -> list[Column]:
    return [F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")]


def _with_inference(out: DataFrame, center: str, alpha: float, alternative: str, more: dict[str, Column] | None = None) -> DataFrame:
    """p-value and two-sided interval, added last: their expressions are long, and each step that follows reads them again."""
    half = tails.t_isf(alpha / 2, F.col("df")) * F.col("se")
    out = out.withColumns({"p_value": tails.t_p(F.col("t"), F.col("df"), alternative), "_half": half, **(more or {})})
    return out.withColumns({"ci_low": F.col(center) - F.col("_half"), "ci_high": F.col(center) + F.col("_half")}).drop("_half")


def _verdict(out: DataFrame, met: Column, alternative: str) -> DataFrame:
    return out.withColumn("assumptions_met", met).withColumn("recommended_alternative", F.when(~met, alternative))


def _join_keys(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    b = b.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(by)], *[c for c in b.columns if c not in by])
    on = [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(by)]
    return (a.join(b, on, "left") if by else a.crossJoin(b)).drop(*[f"_j{i}" for i in range(len(by))])


def one_sample_t_test(df: DataFrame, column: str, popmean: float, alpha: float = 0.05, alternative: str = "two-sided", by: Sequence[str] = ()) -> DataFrame:
    """t test of a mean; the interval is two-sided whatever the alternative."""
    require_alternative(alternative)
    values = complete(df, by, x=column)
    s = values.groupBy(*by).agg(*_moments())
    se = F.col("sd") / F.sqrt("n")
    out = s.select(*by, F.col("n").cast("long").alias("n"), "mean", F.try_divide(F.col("mean") - popmean, se).alias("t"), (F.col("n") - 1).alias("df"), F.try_divide(F.col("mean") - popmean, F.col("sd")).alias("cohens_d"), se.alias("se"))
    normal = normality_check(values, "x", by).select(*by, F.col("passed").alias("normal"))
    out = _verdict(_join_keys(out, normal, by), F.col("normal") | (F.col("n") >= LARGE), "wilcoxon_signed_rank_test")
    return _with_inference(out, "mean", alpha, alternative)


def two_sample_t_test(df: DataFrame, group_col: str, value_col: str, equal_var: bool = False, alpha: float = 0.05, alternative: str = "two-sided") -> DataFrame:
    """Welch's test (or the pooled one) of two groups, in sorted order; Cohen's d uses the pooled deviation in both."""
    require_alternative(alternative)
    values = complete(df, labels={"g": group_col}, x=value_col)
    s = values.groupBy("g").agg(*_moments())
    both = s.agg(F.sort_array(F.collect_list(F.struct("g", "n", "mean", "sd"))).alias("s"))
    two = both.select(F.when(F.size("s") == 2, F.col("s")).otherwise(F.raise_error(F.concat(F.lit("needs exactly two groups, found "), F.size("s").cast("string")))).alias("s"))
    a, b = F.col("s")[0], F.col("s")[1]
    va, vb = a["sd"] * a["sd"] / a["n"], b["sd"] * b["sd"] / b["n"]
    pooled = ((a["n"] - 1) * a["sd"] * a["sd"] + (b["n"] - 1) * b["sd"] * b["sd"]) / (a["n"] + b["n"] - 2)
    se = F.sqrt(pooled * (1 / a["n"] + 1 / b["n"])) if equal_var else F.sqrt(va + vb)
    dof = a["n"] + b["n"] - 2 if equal_var else F.try_divide((va + vb) * (va + vb), va * va / (a["n"] - 1) + vb * vb / (b["n"] - 1))
    gap = a["mean"] - b["mean"]
    out = two.select(
        a["g"].cast("string").alias("group_a"), b["g"].cast("string").alias("group_b"), a["n"].cast("long").alias("n_a"), b["n"].cast("long").alias("n_b"),
        a["mean"].alias("mean_a"), b["mean"].alias("mean_b"), gap.alias("difference"), F.try_divide(gap, se).alias("t"), dof.alias("df"), F.try_divide(gap, F.sqrt(pooled)).alias("cohens_d"), se.alias("se"),
    )
    normal = normality_check(values, "x", ["g"]).agg(F.min("passed").alias("both_normal"))
    levene = distances_anova(values).select(F.col("f").alias("_f"), F.col("df1").alias("_df1"), F.col("df2").alias("_df2"))
    out = _verdict(out.crossJoin(normal).crossJoin(levene), F.col("both_normal") | (F.least("n_a", "n_b") >= LARGE), "mann_whitney_u_test")
    return _with_inference(out, "difference", alpha, alternative, {"levene_p": tails.f_sf(F.col("_f"), F.col("_df1"), F.col("_df2"))}).drop("_f", "_df1", "_df2")


def paired_t_test(df: DataFrame, column_a: str, column_b: str, alpha: float = 0.05, alternative: str = "two-sided", by: Sequence[str] = ()) -> DataFrame:
    """t test of the differences of complete pairs."""
    require_numeric(df, column_a, column_b)
    diff = df.select(*by, (number(column_a) - number(column_b)).alias("d"))
    return one_sample_t_test(diff, "d", 0.0, alpha, alternative, by).withColumnRenamed("mean", "mean_difference")


def one_way_anova(df: DataFrame, group_col: str, value_col: str, alpha: float = 0.05) -> DataFrame:
    """F test of equal means, with eta squared and the checks that decide on the alternative."""
    values = complete(df, labels={"g": group_col}, x=value_col)
    out = anova_of(values.groupBy("g").agg(F.count("x").cast("double").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")))
    out = out.select("f", "df1", "df2", "eta_squared", F.col("k").cast("long").alias("n_groups"), F.col("total").cast("long").alias("n"))
    normal = normality_check(values, "x", ["g"]).agg(F.min("passed").alias("all_normal"), F.min("n").alias("smallest_group"))
    levene = distances_anova(values).select(F.col("f").alias("levene_f"), F.col("df1").alias("_df1"), F.col("df2").alias("_df2"))
    out = out.crossJoin(normal).crossJoin(levene)
    out = out.withColumns({"p_value": tails.f_sf(F.col("f"), F.col("df1"), F.col("df2")), "levene_p": tails.f_sf(F.col("levene_f"), F.col("_df1"), F.col("_df2"))}).drop("_df1", "_df2")
    out = out.withColumns({"significant": F.col("p_value") < alpha, "equal_variances": F.col("levene_p") > LEVEL})
    return _verdict(out, F.col("all_normal") & F.col("equal_variances"), "kruskal_wallis_test")


def pairwise_tukey_posthoc(df: DataFrame, group_col: str, value_col: str, alpha: float = 0.05) -> DataFrame:
    """Tukey-Kramer intervals of all pairs of group means."""
    values = complete(df, labels={"g": group_col}, x=value_col)
    s = values.groupBy("g").agg(F.count("x").cast("double").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    pooled = s.agg(F.count("*").cast("double").alias("k"), (F.sum("n") - F.count("*")).alias("df"), (F.sum(F.col("n") * F.col("var")) / (F.sum("n") - F.count("*"))).alias("msw"))
    b = s.select(*[F.col(c).alias(f"{c}2") for c in ("g", "n", "mean")])
    pairs = s.join(b, F.col("g") < F.col("g2")).crossJoin(F.broadcast(pooled))
    gap, se = F.col("mean2") - F.col("mean"), F.sqrt(F.col("msw") / 2 * (1 / F.col("n") + 1 / F.col("n2")))
    out = pairs.select(F.col("g").cast("string").alias("group1"), F.col("g2").cast("string").alias("group2"), gap.alias("meandiff"), se.alias("se"), "k", "df")
    out = out.withColumn("p_adj", dist.column(lambda d, e, k, f: dist.studentized_range_sf(abs(d) / e, k, f), *[F.col(c) for c in ("meandiff", "se", "k", "df")]))
    crit = dist.column(dist.studentized_range_isf, F.lit(alpha), F.col("k"), F.col("df")) * F.col("se")
    out = out.withColumn("crit", crit)
    return out.select("group1", "group2", "meandiff", "p_adj", (F.col("meandiff") - F.col("crit")).alias("lower"), (F.col("meandiff") + F.col("crit")).alias("upper"), (F.col("p_adj") < alpha).alias("reject"))


def pearson_correlation_test(df: DataFrame, column_a: str, column_b: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of complete pairs with its two-sided p-value."""
    pairs = complete(df, by, x=column_a, y=column_b)
    out = pairs.groupBy(*by).agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")).withColumn("df", (F.col("n") - 2).cast("double"))
    for name in ("x", "y"):
        out = _join_keys(out, normality_check(pairs, name, by).select(*by, F.col("passed").alias(f"normal_{name}")), by)
    out = _verdict(out, F.col("normal_x") & F.col("normal_y"), "spearman_correlation_test")
    return out.withColumn("p_value", correlation_p(F.col("r"), F.col("df")))


def correlation_p(r: Column, df: Column) -> Column:
    return F.when(F.abs(r) >= 1, 0.0).when(df > 0, tails.t_p(r * F.sqrt(df / (1 - r * r)), df))
