"""Queries over the driver's tables, and the same in SQL from textbook formulas.

Figures are rounded on both sides. p-values whose distribution SQL lacks are
left out of compared queries and tested against published values instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.columns import rounded
from statloom.functions.scratch import scratch_path
from statloom.jobs import linear_sql, series_sql, tails_sql
from statloom.operators import checks, decomposition, describe, encode, grouped, nonparametric, parametric, regression, resample, selection, split, stationarity, timeseries, transform
from statloom.streaming.windows import windowed_moments
from statloom.sources.io import preview, profile_dataset, read_dataset, write_dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[rounded(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 4) + 0.0 AS std, round(min({c}), 4) + 0.0 AS min, round(quantile_cont({c}, 0.25), 4) + 0.0 AS q25, round(quantile_cont({c}, 0.5), 4) + 0.0 AS q50, round(quantile_cont({c}, 0.75), 4) + 0.0 AS q75, round(max({c}), 4) + 0.0 AS max FROM lineitem"
    for c in MEASURES))
def _describe(spark, d):
    return describe.describe(_t(spark, d, "lineitem"), MEASURES)


def _matrix_sql(pair: str, diagonal: str = "1.0") -> str:
    parts = [f"SELECT '{a}' AS column_a, '{b}' AS column_b, {diagonal if a == b else pair.format(a=a, b=b)} AS correlation" + (" FROM t" if a != b else "") for a in MEASURES for b in MEASURES]
    return " UNION ALL ".join(parts)


@query("correlation_pearson", "WITH t AS (SELECT * FROM lineitem) " + _matrix_sql("round(corr({a}, {b}), 4) + 0.0"))
def _pearson_matrix(spark, d):
    return describe.correlation_matrix(_t(spark, d, "lineitem"), MEASURES)


_MIDRANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in MEASURES)


@query("correlation_spearman", f"WITH t AS (SELECT {_MIDRANKS} FROM lineitem) " + _matrix_sql("round(corr({a}, {b}), 4) + 0.0"))
def _spearman_matrix(spark, d):
    return describe.correlation_matrix(_t(spark, d, "lineitem"), MEASURES, "spearman")


@query("profile_dataset", "SELECT i AS position, c AS \"column\", t AS type, n AS n_rows, n AS n_values FROM (SELECT count(*) AS n FROM part), (VALUES (0, 'p_partkey', 'bigint'), (1, 'p_name', 'string'), (2, 'p_brand', 'string'), (3, 'p_type', 'string'), (4, 'p_size', 'int'), (5, 'p_retailprice', 'double')) AS v(i, c, t)")
def _profile(spark, d):
    return profile_dataset(_t(spark, d, "part"))


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def _preview(spark, d):
    return preview(_t(spark, d, "orders"), 5, "o_orderkey")


@query("read_write_dataset", "SELECT * FROM supplier")
def _read_write(spark, d):
    path = scratch_path(spark, "copy.parquet")
    write_dataset(read_dataset(spark, f"{d}/supplier.parquet"), path)
    return read_dataset(spark, path)


@query("one_sample_t_test", """
SELECT count(*) AS n, round(avg(l_quantity), 4) AS mean, (count(*) - 1)::DOUBLE AS df,
       round((avg(l_quantity) - 25.5) / (stddev_samp(l_quantity) / sqrt(count(*))), 4) + 0.0 AS t,
       round((avg(l_quantity) - 25.5) / stddev_samp(l_quantity), 6) + 0.0 AS cohens_d FROM lineitem""")
def _one_sample(spark, d):
    out = parametric.one_sample_t_test(_t(spark, d, "lineitem"), "l_quantity", 25.5)
    return out.select("n", "df", rounded(F.col("mean")).alias("mean"), rounded(F.col("t")).alias("t"), rounded(F.col("cohens_d"), 6).alias("cohens_d"))


_TWO = """
WITH g AS (SELECT l_linestatus AS g, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1),
p AS (SELECT a.g AS group_a, b.g AS group_b, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb,
      ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS pooled FROM g a JOIN g b ON a.g < b.g)
SELECT group_a, group_b, na::BIGINT AS n_a, nb::BIGINT AS n_b, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round((ma - mb) / sqrt(pooled), 6) + 0.0 AS cohens_d,
"""


@query("two_sample_t_test", _TWO + "round((ma - mb) / sqrt(va / na + vb / nb), 4) + 0.0 AS t, round((va / na + vb / nb)^2 / ((va / na)^2 / (na - 1) + (vb / nb)^2 / (nb - 1)), 2) AS df FROM p")
def _two_sample(spark, d):
    out = parametric.two_sample_t_test(_t(spark, d, "lineitem"), "l_linestatus", "l_extendedprice")
    return out.select("group_a", "group_b", "n_a", "n_b", rounded(F.col("mean_a")).alias("mean_a"), rounded(F.col("mean_b")).alias("mean_b"), rounded(F.col("cohens_d"), 6).alias("cohens_d"), rounded(F.col("t")).alias("t"), rounded(F.col("df"), 2).alias("df"))


@query("two_sample_t_test_pooled", _TWO + "round((ma - mb) / sqrt(pooled * (1 / na + 1 / nb)), 4) + 0.0 AS t, na + nb - 2 AS df FROM p")
def _two_sample_pooled(spark, d):
    out = parametric.two_sample_t_test(_t(spark, d, "lineitem"), "l_linestatus", "l_extendedprice", equal_var=True)
    return out.select("group_a", "group_b", "n_a", "n_b", rounded(F.col("mean_a")).alias("mean_a"), rounded(F.col("mean_b")).alias("mean_b"), rounded(F.col("cohens_d"), 6).alias("cohens_d"), rounded(F.col("t")).alias("t"), "df")


@query("paired_t_test", """
WITH x AS (SELECT p_retailprice - p_size AS v FROM part)
SELECT count(*) AS n, round(avg(v), 4) AS mean_difference, (count(*) - 1)::DOUBLE AS df, round(avg(v) / (stddev_samp(v) / sqrt(count(*))), 4) + 0.0 AS t, round(avg(v) / stddev_samp(v), 4) + 0.0 AS cohens_d FROM x""")
def _paired(spark, d):
    return _round(parametric.paired_t_test(_t(spark, d, "part"), "p_retailprice", "p_size"), ["n", "mean_difference", "df", "t", "cohens_d"])


def _f_sql(source: str) -> str:
    return f"""g AS (SELECT g, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v FROM {source} GROUP BY 1),
t AS (SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum(n * v) AS ssw FROM g),
s AS (SELECT k, t.n AS n, ssw, sum(g.n * (m - gm)^2) AS ssb FROM g, t GROUP BY ALL)"""


_BF = "med AS (SELECT g, median(x) AS md FROM base GROUP BY 1), z AS (SELECT base.g AS g, abs(x - md) AS x FROM base JOIN med USING (g)), "


@query("one_way_anova", f"""
WITH base AS (SELECT l_returnflag AS g, l_extendedprice AS x FROM lineitem), {_f_sql('base')}
SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS f, k - 1 AS df1, n - k AS df2, round(ssb / (ssb + ssw), 6) + 0.0 AS eta_squared, k::BIGINT AS n_groups, n::BIGINT AS n FROM s""")
def _anova(spark, d):
    out = parametric.one_way_anova(_t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.select(rounded(F.col("f")).alias("f"), "df1", "df2", rounded(F.col("eta_squared"), 6).alias("eta_squared"), "n_groups", "n")


@query("anova_with_checks")
def _anova_checks(spark, d):
    return parametric.one_way_anova(_t(spark, d, "events"), "event_type", "value")


@query("homogeneity_of_variance", f"""
WITH base AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), {_BF}{_f_sql('z')}
SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS statistic, k - 1 AS df1, n - k AS df2 FROM s""")
def _levene(spark, d):
    return _round(checks.homogeneity_of_variance(_t(spark, d, "customer"), "c_mktsegment", "c_acctbal"), ["statistic", "df1", "df2"])


@query("pairwise_tukey_posthoc", """
WITH g AS (SELECT event_type AS g, avg(value) AS m FROM events GROUP BY 1)
SELECT a.g AS group1, b.g AS group2, round(b.m - a.m, 4) + 0.0 AS meandiff FROM g a JOIN g b ON a.g < b.g""")
def _tukey(spark, d):
    return _round(parametric.pairwise_tukey_posthoc(_t(spark, d, "events"), "event_type", "value"), ["group1", "group2", "meandiff"])


@query("tukey_p_values", f"""
WITH g AS (SELECT c_mktsegment AS g, count(*)::DOUBLE AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1),
t AS (SELECT sum(n * v) / (sum(n) - count(*)) AS msw, sum(n) - count(*) AS df FROM g),
v AS (SELECT a.g || '|' || b.g AS id, abs(b.m - a.m) / sqrt(msw / 2 * (1 / a.n + 1 / b.n)) AS q, df FROM g a JOIN g b ON a.g < b.g, t)
SELECT string_split(id, '|')[1] AS group1, string_split(id, '|')[2] AS group2, round(p, 4) + 0.0 AS p_adj, p < 0.05 AS reject FROM {tails_sql.range_tail('v', 5)}""")
def _tukey_p(spark, d):
    return _round(parametric.pairwise_tukey_posthoc(_t(spark, d, "customer"), "c_mktsegment", "c_acctbal"), ["group1", "group2", "p_adj", "reject"])


@query("tukey_with_intervals")
def _tukey_full(spark, d):
    return parametric.pairwise_tukey_posthoc(_t(spark, d, "events"), "event_type", "value")


@query("pearson_correlation_test", "SELECT round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS r, count(*) AS n, (count(*) - 2)::DOUBLE AS df FROM lineitem")
def _pearson(spark, d):
    out = parametric.pearson_correlation_test(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(rounded(F.col("r"), 6).alias("r"), "n", "df")


@query("normality_by_moments", """
WITH b AS (SELECT l_returnflag, count(*)::DOUBLE AS n, skewness(l_extendedprice) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1)) AS g1, kurtosis_pop(l_extendedprice) AS g2 FROM lineitem GROUP BY 1),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
      3 * (n - 1) / (n + 1) AS e, 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS v,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sq FROM b),
u AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, (g2 + 3 - e) / sqrt(v) AS x, 6 + 8 / sq * (2 / sq + sqrt(1 + 4 / (sq * sq))) AS a FROM s),
z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, ((1 - 2 / (9 * a)) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM u)
SELECT l_returnflag, n::BIGINT AS n, round(z1 * z1 + z2 * z2, 3) AS statistic, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) + 0.0 AS p_value, exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS passed FROM z""")
def _k2(spark, d):
    out = checks.normality_check(_t(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", rounded(F.col("statistic"), 3).alias("statistic"), rounded(F.col("p_value"), 6).alias("p_value"), "passed")


@query("normality_shapiro_wilk")
def _shapiro(spark, d):
    return checks.normality_check(_t(spark, d, "orders"), "o_totalprice", ["o_custkey"])


_DW = "SELECT round(sum((e - p)^2) / sum(e^2), 6) AS statistic, sum((e - p)^2) / sum(e^2) BETWEEN 1.5 AND 2.5 AS passed FROM (SELECT e, lag(e) OVER (ORDER BY o_orderkey) AS p FROM (SELECT o_orderkey, o_totalprice - avg(o_totalprice) OVER () AS e FROM orders))"


@query("durbin_watson", _DW)
def _durbin_watson(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    mean = orders.agg(F.avg("o_totalprice").alias("m"))
    out = checks.durbin_watson(orders.crossJoin(F.broadcast(mean)).select("o_orderkey", (F.col("o_totalprice") - F.col("m")).alias("e")), "e", "o_orderkey")
    return out.select(rounded(F.col("statistic"), 6).alias("statistic"), "passed")


@query("mann_whitney_u_test", """
WITH r AS (SELECT event_type AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events WHERE event_type IN ('click', 'view'))
SELECT 'click' AS group_a, 'view' AS group_b, round(sum(r) FILTER (g = 'click') - count(*) FILTER (g = 'click') * (count(*) FILTER (g = 'click') + 1) / 2.0, 1) AS u,
       count(*) FILTER (g = 'click') AS n_a, count(*) FILTER (g = 'view') AS n_b FROM r""")
def _mann_whitney(spark, d):
    return _round(nonparametric.mann_whitney_u_test(_t(spark, d, "events"), "event_type", "value", groups=("click", "view")), ["group_a", "group_b", "u", "n_a", "n_b"], 1)


@query("wilcoxon_signed_rank_test", """
WITH x AS (SELECT o_totalprice - c_acctbal * 30 AS v FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT v, rank() OVER (ORDER BY abs(v)) + (count(*) OVER (PARTITION BY abs(v)) - 1) / 2.0 AS r FROM x WHERE v <> 0)
SELECT round(sum(r) FILTER (v > 0), 1) AS w_plus, round(sum(r) FILTER (v < 0), 1) AS w_minus, round(least(sum(r) FILTER (v > 0), sum(r) FILTER (v < 0)), 1) AS w, count(*) AS n_nonzero FROM r""")
def _wilcoxon(spark, d):
    both = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_totalprice", (F.col("c_acctbal") * 30).alias("scaled"))
    return _round(nonparametric.wilcoxon_signed_rank_test(both, "o_totalprice", "scaled"), ["w_plus", "w_minus", "w", "n_nonzero"], 1)


_P6 = "round(p, 6) + 0.0 AS p_value"


def _t_inference(stat: str, centre: str) -> str:
    """p-value and interval from ``stat``: (centre, se, df)."""
    return f"""WITH s AS ({stat}), v AS (SELECT 1 AS id, {centre} AS centre, se, df, ({centre} - null_value) / se AS t FROM s)
SELECT {_P6}, round(centre - {tails_sql.t_point('df')} * se, 4) + 0.0 AS ci_low, round(centre + {tails_sql.t_point('df')} * se, 4) + 0.0 AS ci_high FROM v JOIN {tails_sql.t_tail('v')} USING (id)"""


def _inference(out: DataFrame) -> DataFrame:
    return out.select(rounded(F.col("p_value"), 6).alias("p_value"), rounded(F.col("ci_low")).alias("ci_low"), rounded(F.col("ci_high")).alias("ci_high"))


@query("one_sample_t_test_inference", _t_inference("SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) / sqrt(count(*)) AS se, (count(*) - 1)::DOUBLE AS df, 25.5 AS null_value FROM lineitem", "m"))
def _one_sample_inference(spark, d):
    return _inference(parametric.one_sample_t_test(_t(spark, d, "lineitem"), "l_quantity", 25.5))


_TWO_MOMENTS = "(SELECT count(*) FILTER ({g} = 0)::DOUBLE AS na, count(*) FILTER ({g} = 1)::DOUBLE AS nb, avg(x) FILTER ({g} = 0) AS ma, avg(x) FILTER ({g} = 1) AS mb, var_samp(x) FILTER ({g} = 0) AS va, var_samp(x) FILTER ({g} = 1) AS vb FROM (SELECT l_extendedprice AS x, (l_linestatus = 'O')::INT AS g FROM lineitem))".format(g="g")


@query("two_sample_t_test_inference", _t_inference(f"SELECT ma - mb AS m, sqrt(va / na + vb / nb) AS se, (va / na + vb / nb)^2 / ((va / na)^2 / (na - 1) + (vb / nb)^2 / (nb - 1)) AS df, 0 AS null_value FROM {_TWO_MOMENTS}", "m"))
def _two_sample_inference(spark, d):
    return _inference(parametric.two_sample_t_test(_t(spark, d, "lineitem"), "l_linestatus", "l_extendedprice"))


@query("two_sample_t_test_pooled_inference", _t_inference(f"SELECT ma - mb AS m, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) AS se, na + nb - 2 AS df, 0 AS null_value FROM {_TWO_MOMENTS}", "m"))
def _two_sample_pooled_inference(spark, d):
    return _inference(parametric.two_sample_t_test(_t(spark, d, "lineitem"), "l_linestatus", "l_extendedprice", equal_var=True))


@query("paired_t_test_inference", _t_inference("SELECT avg(v) AS m, stddev_samp(v) / sqrt(count(*)) AS se, (count(*) - 1)::DOUBLE AS df, 0 AS null_value FROM (SELECT o_totalprice / 1000 - c_acctbal / 30 AS v FROM orders JOIN customer ON o_custkey = c_custkey)", "m"))
def _paired_inference(spark, d):
    both = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select((F.col("o_totalprice") / 1000).alias("a"), (F.col("c_acctbal") / 30).alias("b"))
    return _inference(parametric.paired_t_test(both, "a", "b"))


@query("correlation_p_values", f"""
WITH x AS (SELECT p_size, p_retailprice, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part),
s AS (SELECT 'pearson' AS id, corr(p_size, p_retailprice) AS r, count(*) - 2.0 AS df FROM x UNION ALL SELECT 'spearman', corr(a, b), count(*) - 2.0 FROM x),
v AS (SELECT id, r * sqrt(df / (1 - r * r)) AS t, df::DOUBLE AS df FROM s)
SELECT id AS test, {_P6} FROM {tails_sql.t_tail('v')}""")
def _correlation_p(spark, d):
    part = _t(spark, d, "part")
    tests = [("pearson", parametric.pearson_correlation_test), ("spearman", nonparametric.spearman_correlation_test)]
    both = [test(part, "p_size", "p_retailprice").select(F.lit(name).alias("test"), rounded(F.col("p_value"), 6).alias("p_value")) for name, test in tests]
    return both[0].unionByName(both[1])


@query("anova_p_values", f"""
WITH base AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), {_BF}{_f_sql('z').replace('g AS (', 'zg AS (').replace(' FROM g', ' FROM zg').replace('t AS (', 'zt AS (').replace('s AS (SELECT k, t.n', 'zs AS (SELECT k, zt.n').replace('sum(g.n', 'sum(zg.n').replace('zg, t ', 'zg, zt ')},
{_f_sql('base')},
v AS (SELECT 'anova' AS id, (ssb / (k - 1)) / (ssw / (n - k)) AS f, k - 1 AS df1, n - k AS df2 FROM s UNION ALL SELECT 'equal variances', (ssb / (k - 1)) / (ssw / (n - k)), k - 1, n - k FROM zs)
SELECT id AS test, {_P6} FROM {tails_sql.f_tail('v')}""")
def _anova_p(spark, d):
    customer = _t(spark, d, "customer")
    anova = parametric.one_way_anova(customer, "c_mktsegment", "c_acctbal").select(F.lit("anova").alias("test"), rounded(F.col("p_value"), 6).alias("p_value"))
    levene = checks.homogeneity_of_variance(customer, "c_mktsegment", "c_acctbal").select(F.lit("equal variances").alias("test"), rounded(F.col("p_value"), 6).alias("p_value"))
    return anova.unionByName(levene)


@query("rank_test_p_values", f"""
WITH r AS (SELECT event_type AS g, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events WHERE event_type IN ('click', 'view')),
k AS (SELECT sum(r) FILTER (g = 'click') AS rs, count(*) FILTER (g = 'click')::DOUBLE AS a, count(*) FILTER (g = 'view')::DOUBLE AS b, count(*)::DOUBLE AS n FROM r),
kt AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY value)),
x AS (SELECT o_totalprice - c_acctbal * 30 AS v FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT v, rank() OVER (ORDER BY abs(v)) + (count(*) OVER (PARTITION BY abs(v)) - 1) / 2.0 AS r FROM x WHERE v <> 0),
ws AS (SELECT least(sum(r) FILTER (v > 0), sum(r) FILTER (v < 0)) AS w, count(*)::DOUBLE AS n FROM w),
wt AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM w GROUP BY abs(v))),
v AS (SELECT 'mann_whitney' AS id, (greatest(rs - a * (a + 1) / 2, a * b - rs + a * (a + 1) / 2) - a * b / 2 - 0.5) / sqrt(a * b / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM k, kt
      UNION ALL SELECT 'wilcoxon', (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) FROM ws, wt)
SELECT id AS test, {_P6} FROM {tails_sql.normal_tail('v')}""")
def _rank_p(spark, d):
    both = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_totalprice", (F.col("c_acctbal") * 30).alias("scaled"))
    mann = nonparametric.mann_whitney_u_test(_t(spark, d, "events"), "event_type", "value", groups=("click", "view"))
    wilcoxon = nonparametric.wilcoxon_signed_rank_test(both, "o_totalprice", "scaled")
    return mann.select(F.lit("mann_whitney").alias("test"), rounded(F.col("p_value"), 6).alias("p_value")).unionByName(wilcoxon.select(F.lit("wilcoxon").alias("test"), rounded(F.col("p_value"), 6).alias("p_value")))


@query("kruskal_wallis_test", """
WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS r FROM lineitem),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM lineitem GROUP BY l_extendedprice)),
s AS (SELECT sum(rs * rs / m) AS s, sum(m) AS n, count(*) AS k FROM (SELECT sum(r) AS rs, count(*)::DOUBLE AS m FROM r GROUP BY g)),
h AS (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n^3 - n)) AS h, k, n FROM s, t)
SELECT round(h, 4) + 0.0 AS h, (k - 1)::DOUBLE AS df, n::BIGINT AS n, k AS n_groups, round(exp(-h / 2), 4) + 0.0 AS p_value FROM h""")
def _kruskal(spark, d):
    return _round(nonparametric.kruskal_wallis_test(_t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"), ["h", "df", "n", "n_groups", "p_value"])


@query("spearman_correlation_test", """
SELECT round(corr(a, b), 6) + 0.0 AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a,
       rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)""")
def _spearman(spark, d):
    out = nonparametric.spearman_correlation_test(_t(spark, d, "part"), "p_size", "p_retailprice")
    return out.select(rounded(F.col("rho"), 6).alias("rho"), "n")


def _independence_sql(table: str, a: str, b: str, yates: bool, p: str) -> str:
    gap = "greatest(abs(coalesce(o, 0) - e) - 0.5, 0)" if yates else "abs(coalesce(o, 0) - e)"
    return f"""WITH c AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM {table} GROUP BY ALL),
r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), q AS (SELECT b, sum(o) AS qb FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c),
f AS (SELECT o, ra * qb / n AS e, n FROM r CROSS JOIN q CROSS JOIN n LEFT JOIN c USING (a, b)),
s AS (SELECT sum({gap}^2 / e) AS chi2, any_value(n) AS n, avg((e < 5)::INT) AS share FROM f)
SELECT round(chi2, 4) + 0.0 AS chi2, ((SELECT count(*) FROM r) - 1.0) * ((SELECT count(*) FROM q) - 1) AS df, n::BIGINT AS n,
       round(sqrt(chi2 / (n * (least((SELECT count(*) FROM r), (SELECT count(*) FROM q)) - 1))), 6) + 0.0 AS cramers_v, round(share, 4) + 0.0 AS share_below_5{p} FROM s"""


@query("sample_size_check", "SELECT c_nationkey, count(c_acctbal) AS n, " + ", ".join(f"count(c_acctbal) >= {m} AS enough_for_{name}" for name, m in checks.LEAST_ROWS.items()) + " FROM customer GROUP BY c_nationkey")
def _sample_sizes(spark, d):
    return checks.sample_sizes(_t(spark, d, "customer"), "c_acctbal", ["c_nationkey"])


@query("chi_square_test_independence", _independence_sql("lineitem", "l_returnflag", "l_linestatus", False, ", round(exp(-chi2 / 2), 4) + 0.0 AS p_value"))
def _independence(spark, d):
    out = nonparametric.chi_square_test_independence(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select(rounded(F.col("chi2")).alias("chi2"), "df", "n", rounded(F.col("cramers_v"), 6).alias("cramers_v"), rounded(F.col("share_below_5")).alias("share_below_5"), rounded(F.col("p_value")).alias("p_value"))


@query("chi_square_yates", _independence_sql("labels", "quality", "toxic", True, ""))
def _yates(spark, d):
    out = nonparametric.chi_square_test_independence(_t(spark, d, "labels"), "quality", "toxic")
    return out.select(rounded(F.col("chi2")).alias("chi2"), "df", "n", rounded(F.col("cramers_v"), 6).alias("cramers_v"), rounded(F.col("share_below_5")).alias("share_below_5"))


@query("chi_square_goodness_of_fit", """
WITH c AS (SELECT count(*)::DOUBLE AS o, sum(count(*)) OVER () / count(*) OVER () AS e, sum(count(*)) OVER () AS n FROM orders GROUP BY o_orderpriority),
s AS (SELECT sum((o - e)^2 / e) AS x, count(*) - 1.0 AS df, any_value(n)::BIGINT AS n FROM c)
SELECT round(x, 4) + 0.0 AS chi2, df::DOUBLE AS df, n, round(exp(-x / 2) * (1 + x / 2), 4) + 0.0 AS p_value FROM s""")
def _fit(spark, d):
    return _round(nonparametric.chi_square_goodness_of_fit(_t(spark, d, "orders"), "o_orderpriority"), ["chi2", "df", "n", "p_value"])


@query("chi_square_weighted_fit", """
WITH c AS (SELECT l_returnflag AS c, count(*)::DOUBLE AS o FROM lineitem GROUP BY 1), w(c, w) AS (VALUES ('A', 1.0), ('N', 2.0), ('R', 1.0)),
s AS (SELECT sum((o - w / 4 * n)^2 / (w / 4 * n)) AS x, any_value(n) AS n FROM c JOIN w USING (c), (SELECT sum(o) AS n FROM c))
SELECT round(x, 4) + 0.0 AS chi2, 2.0::DOUBLE AS df, n::BIGINT AS n, round(exp(-x / 2), 4) + 0.0 AS p_value FROM s""")
def _weighted_fit(spark, d):
    return _round(nonparametric.chi_square_goodness_of_fit(_t(spark, d, "lineitem"), "l_returnflag", [1, 2, 1]), ["chi2", "df", "n", "p_value"])


def _signal(spark, d) -> DataFrame:
    """A target that depends on two predictors, with the price as noise."""
    y = 5 + 2 * F.col("l_quantity") + 300 * F.col("l_discount") + F.col("l_extendedprice") / 1000
    return _t(spark, d, "lineitem").select(y.alias("y"), "l_quantity", "l_discount", "l_tax", (1 / (F.col("l_quantity") * F.col("l_quantity"))).alias("w"))


_SIGNAL = "SELECT 5 + 2 * l_quantity + 300 * l_discount + l_extendedprice / 1000 AS y, l_quantity AS a, l_discount AS b, l_tax AS c, {w} AS w FROM lineitem"


def _two_predictor_sql(w: str) -> str:
    """Normal equations of y on a and b by Cramer's rule, over weighted centred sums."""
    return f"""WITH x AS ({_SIGNAL.format(w=w)}), m AS (SELECT sum(w) AS sw, sum(w * y) / sum(w) AS my, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, count(*)::DOUBLE AS n FROM x),
s AS (SELECT any_value(sw) AS sw, any_value(my) AS my, any_value(ma) AS ma, any_value(mb) AS mb, any_value(n) AS n, sum(w * (a - ma)^2) AS aa, sum(w * (b - mb)^2) AS bb, sum(w * (a - ma) * (b - mb)) AS ab,
      sum(w * (a - ma) * (y - my)) AS ay, sum(w * (b - mb) * (y - my)) AS bby, sum(w * (y - my)^2) AS yy FROM x, m),
c AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - bby * ab) / (aa * bb - ab * ab) AS ca, (bby * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s),
f AS (SELECT *, (yy - ca * ay - cb * bby) / (n - 3) AS s2, my - ca * ma - cb * mb AS c0 FROM c),
t AS (SELECT 'const' AS term, c0 AS coef, sqrt(s2 * (1 / sw + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)) AS se FROM f
      UNION ALL SELECT 'l_quantity', ca, sqrt(s2 * bb / det) FROM f UNION ALL SELECT 'l_discount', cb, sqrt(s2 * aa / det) FROM f)
"""


_COEF = "SELECT term, round(coef, 3) + 0.0 AS coef, round(se, 3) + 0.0 AS std_err FROM t"


def _coef3(result) -> DataFrame:
    return _round(result.coefficients, ["term", "coef", "std_err"], 3)


@query("linear_regression", _two_predictor_sql("1") + _COEF)
def _ols(spark, d):
    return _coef3(regression.linear_regression(_signal(spark, d), "y", ["l_quantity", "l_discount"]))


@query("linear_regression_summary", _two_predictor_sql("1") + "SELECT round(1 - s2 * (n - 3) / yy, 6) AS r_squared, n::BIGINT AS n, 2.0::DOUBLE AS df_model, n - 3 AS df_resid, round(((yy - s2 * (n - 3)) / 2) / s2, 2) AS f FROM f")
def _ols_summary(spark, d):
    out = regression.linear_regression(_signal(spark, d), "y", ["l_quantity", "l_discount"]).summary
    return out.select(rounded(F.col("r_squared"), 6).alias("r_squared"), "n", "df_model", "df_resid", rounded(F.col("f"), 2).alias("f"))


@query("weighted_linear_regression", _two_predictor_sql("1 / (l_quantity * l_quantity)") + _COEF)
def _wls(spark, d):
    return _coef3(regression.weighted_linear_regression(_signal(spark, d), "y", ["l_quantity", "l_discount"], "w"))


def _irls_terms(rows: DataFrame, digits: int) -> DataFrame:
    result, rounds, done = regression.irls_regression(rows, "y", ["l_quantity", "l_discount"])
    return result.coefficients.select("term", rounded(F.col("coef"), digits).alias("coef"), F.lit(rounds).alias("iterations"), F.lit(done).alias("converged"))


@query("irls_regression", linear_sql.irls_sql(_SIGNAL.format(w=1), 4))
def _irls(spark, d):
    return _irls_terms(_signal(spark, d), 3)


@query("irls_regression_uneven", linear_sql.irls_sql("SELECT 5 + 2 * l_quantity + 300 * l_discount + (l_tax - 0.04) * l_quantity * l_quantity AS y, l_quantity AS a, l_discount AS b FROM lineitem", 20, 2))
def _irls_uneven(spark, d):
    q = F.col("l_quantity")
    y = 5 + 2 * q + 300 * F.col("l_discount") + (F.col("l_tax") - 0.04) * q * q
    return _irls_terms(_t(spark, d, "lineitem").select(y.alias("y"), "l_quantity", "l_discount"), 2)


@query("breusch_pagan", """
WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
SELECT round(count(*) * corr((l_extendedprice - i - s * l_quantity)^2, l_quantity)^2, 4) + 0.0 AS breusch_pagan, count(*) AS n FROM lineitem, m""")
def _bp(spark, d):
    return _round(regression.linear_regression(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]).summary, ["breusch_pagan", "n"])


@query("vif", """
WITH s AS (SELECT sum(l_quantity^2) AS aa, sum(l_discount^2) AS bb, sum(l_quantity * l_discount) AS ab FROM lineitem)
SELECT 'l_quantity' AS predictor, round(aa * bb / (aa * bb - ab * ab), 4) AS vif, aa * bb / (aa * bb - ab * ab) <= 5 AS passed FROM s
UNION ALL SELECT 'l_discount', round(aa * bb / (aa * bb - ab * ab), 4), aa * bb / (aa * bb - ab * ab) <= 5 FROM s""")
def _vif(spark, d):
    return _round(regression.vif(_t(spark, d, "lineitem"), ["l_quantity", "l_discount"]), ["predictor", "vif", "passed"])


_AIC = """r AS (SELECT n, yy, yy - ay * ay / aa AS ra, yy - bby * bby / bb AS rb, yy - ca * ay - cb * bby AS rab FROM c),
models(model, aic) AS (SELECT 'l_quantity', n * ln(ra) + 4 FROM r UNION ALL SELECT 'l_discount', n * ln(rb) + 4 FROM r UNION ALL SELECT 'l_quantity,l_discount', n * ln(rab) + 6 FROM r)
"""


def _selection_sql(tail: str) -> str:
    body = _two_predictor_sql("1")
    return body[: body.index("f AS (SELECT *, (yy")] + _AIC + tail


@query("best_subset_selection", _selection_sql("SELECT model AS predictors FROM models ORDER BY aic LIMIT 1"))
def _best_subset(spark, d):
    chosen = selection.best_subset_selection(_signal(spark, d), "y", ["l_quantity", "l_discount"])[1]
    return spark.createDataFrame([(",".join(chosen),)], "predictors string")


@query("forward_selection", _selection_sql("""SELECT 1 AS step, (SELECT model FROM models WHERE model NOT LIKE '%,%' ORDER BY aic LIMIT 1) AS predictor
UNION ALL SELECT 2, (SELECT model FROM models WHERE model NOT LIKE '%,%' ORDER BY aic DESC LIMIT 1) WHERE (SELECT aic FROM models WHERE model LIKE '%,%') < (SELECT min(aic) FROM models WHERE model NOT LIKE '%,%')"""))
def _forward(spark, d):
    return selection.forward_selection(_signal(spark, d), "y", ["l_quantity", "l_discount"])[1].select("step", "predictor")


_NOISE = "SELECT 5 + 2 * l_quantity + 300 * l_discount + l_extendedprice / 1000 AS y, l_quantity, l_discount, (l_partkey * 7919 + l_suppkey * 31) % 1009 AS noise_a, (l_partkey * 104729 + l_linenumber * 17) % 997 AS noise_b FROM lineitem"


@query("backward_elimination", linear_sql.backward_sql(_NOISE, ["l_quantity", "l_discount", "noise_a", "noise_b"]))
def _backward(spark, d):
    y = 5 + 2 * F.col("l_quantity") + 300 * F.col("l_discount") + F.col("l_extendedprice") / 1000
    part, line = F.col("l_partkey").cast("long"), F.col("l_linenumber").cast("long")
    noisy = _t(spark, d, "lineitem").select(y.alias("y"), "l_quantity", "l_discount", ((part * 7919 + F.col("l_suppkey") * 31) % 1009).alias("noise_a"), ((part * 104729 + line * 17) % 997).alias("noise_b"))
    steps = selection.backward_elimination(noisy, "y", ["l_quantity", "l_discount", "noise_a", "noise_b"], criterion="bic")[1]
    return steps.select(F.col("step").cast("long").alias("step"), "predictor", rounded(F.col("score"), 2).alias("score"))


_LOGIT = ["l_quantity", "l_discount", "l_tax"]
_LOGIT_ROWS = "SELECT l_linestatus, (l_returnflag = 'R')::INT AS y, l_quantity, l_discount, l_tax FROM lineitem"


def _flagged(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), *_LOGIT, "l_extendedprice")


@query("logistic_regression", linear_sql.logistic_sql(_LOGIT_ROWS, _LOGIT, tail="SELECT term, round(coef, 4) + 0.0 AS coef, round(exp(coef), 4) AS odds_ratio FROM t"))
def _logistic(spark, d):
    return regression.logistic_regression(_flagged(spark, d), "y", _LOGIT).coefficients.select("term", "coef", "odds_ratio")


@query("logistic_regression_summary", linear_sql.logistic_sql(_LOGIT_ROWS, _LOGIT, tail="SELECT round(2 * (llf - ones * ln(ones / n) - (n - ones) * ln(1 - ones / n)), 4) AS lr_chi2, 3.0::DOUBLE AS df, round(1 - llf / (ones * ln(ones / n) + (n - ones) * ln(1 - ones / n)), 6) AS mcfadden, n FROM t WHERE term = 'const'"))
def _logistic_summary(spark, d):
    out = regression.logistic_regression(_flagged(spark, d), "y", _LOGIT).summary
    return out.select(rounded(F.col("lr_chi2")).alias("lr_chi2"), "df", rounded(F.col("mcfadden"), 6).alias("mcfadden"), "n")


@query("logistic_regression_by", linear_sql.logistic_sql(_LOGIT_ROWS, _LOGIT, ["l_linestatus"], tail="SELECT l_linestatus, term, round(coef, 4) + 0.0 AS coef, round(std_err, 4) AS std_err, round(llf, 3) AS llf, n FROM t"))
def _logistic_by(spark, d):
    out = grouped.logistic_regression_by(_flagged(spark, d), ["l_linestatus"], "y", _LOGIT)
    return out.select("l_linestatus", "term", rounded(F.col("coef")).alias("coef"), rounded(F.col("std_err")).alias("std_err"), rounded(F.col("llf"), 3).alias("llf"), "n")


@query("linear_regression_by", linear_sql.linear_by_sql("lineitem", "l_suppkey", "l_extendedprice", ["l_quantity", "l_discount"], "SELECT l_suppkey, term, round(coef, 3) + 0.0 AS coef, round(std_err, 3) AS std_err, n FROM t"))
def _linear_by(spark, d):
    out = grouped.linear_regression_by(_t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", ["l_quantity", "l_discount"])
    return _round(out, ["l_suppkey", "term", "coef", "std_err", "n"], 3)


@query("one_way_anova_by", f"""
WITH g AS (SELECT l_linenumber, l_returnflag AS g, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
a AS (SELECT l_linenumber, sum(n * m) / sum(n) AS gm FROM g GROUP BY 1),
s AS (SELECT l_linenumber, count(*)::DOUBLE AS k, sum(n) AS n, sum(n * v) AS ssw, sum(n * (m - gm)^2) AS ssb FROM g JOIN a USING (l_linenumber) GROUP BY 1),
v AS (SELECT l_linenumber AS id, (ssb / (k - 1)) / (ssw / (n - k)) AS f, k - 1 AS df1, n - k AS df2, ssb / (ssb + ssw) AS eta, n FROM s)
SELECT id AS l_linenumber, round(f, 4) AS f, df1, df2, round(eta, 6) + 0.0 AS eta_squared, n::BIGINT AS n, {_P6} FROM v JOIN {tails_sql.f_tail('v')} USING (id)""")
def _anova_by(spark, d):
    out = grouped.one_way_anova_by(_t(spark, d, "lineitem"), ["l_linenumber"], "l_returnflag", "l_extendedprice")
    return out.select("l_linenumber", rounded(F.col("f")).alias("f"), "df1", "df2", rounded(F.col("eta_squared"), 6).alias("eta_squared"), "n", rounded(F.col("p_value"), 6).alias("p_value"))


@query("kruskal_wallis_test_by", """
WITH r AS (SELECT l_linenumber AS k, l_returnflag AS g, l_extendedprice AS x, rank() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linenumber, l_extendedprice) - 1) / 2.0 AS r FROM lineitem),
t AS (SELECT k, sum(c * c * c - c) AS ties FROM (SELECT k, count(*)::DOUBLE AS c FROM r GROUP BY k, x) GROUP BY k),
s AS (SELECT k, sum(rs * rs / m) AS s, sum(m) AS n, count(*) AS groups FROM (SELECT k, g, sum(r) AS rs, count(*)::DOUBLE AS m FROM r GROUP BY k, g) GROUP BY k),
h AS (SELECT k, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n^3 - n)) AS h, n, groups FROM s JOIN t USING (k))
SELECT k AS l_linenumber, round(h, 4) + 0.0 AS h, (groups - 1)::DOUBLE AS df, n::BIGINT AS n, groups AS n_groups, round(exp(-h / 2), 6) + 0.0 AS p_value FROM h""")
def _kruskal_by(spark, d):
    out = grouped.kruskal_wallis_test_by(_t(spark, d, "lineitem"), ["l_linenumber"], "l_returnflag", "l_extendedprice")
    return out.select("l_linenumber", rounded(F.col("h")).alias("h"), "df", "n", "n_groups", rounded(F.col("p_value"), 6).alias("p_value"))


_JACK = """WITH s AS (SELECT count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM events),
r AS (SELECT {theta} AS theta, n, {rep} AS rep FROM events, s)
SELECT '{name}' AS statistic, any_value(n)::BIGINT AS n, round(any_value(theta), 4) AS estimate, round((any_value(n) - 1) * (avg(rep - theta)), 4) + 0.0 AS bias,
       round(sqrt((any_value(n) - 1) / any_value(n) * var_pop(rep - theta) * any_value(n)), 4) AS std_err FROM r"""
_LOO = "greatest(v * n - (value - m)^2 * n / (n - 1), 0) / (n - 1)"


def _jackknife(name: str, theta: str, rep: str) -> None:
    @query(f"jackknife_{name}", _JACK.format(name=name, theta=theta, rep=rep))
    def run(spark, d):
        return _round(resample.jackknife(_t(spark, d, "events"), "value", name), ["statistic", "n", "estimate", "bias", "std_err"])


_jackknife("mean", "m", "m - (value - m) / (n - 1)")
_jackknife("var", "v", _LOO)
_jackknife("std", "sqrt(v)", f"sqrt({_LOO})")


@query("jackknife_median", """
WITH o AS (SELECT value, row_number() OVER (ORDER BY value, event_id) AS i, count(*) OVER () AS n FROM events),
k AS (SELECT any_value(n) AS n, any_value(n) // 2 AS m FROM o), p AS (SELECT k.n AS n, k.m AS m, max(value) FILTER (i = m) AS a, max(value) FILTER (i = m + 1) AS b, max(value) FILTER (i = m + 2) AS c FROM o, k GROUP BY ALL),
r AS (SELECT p.n AS n, CASE WHEN p.n % 2 = 0 THEN (a + b) / 2 ELSE b END AS theta, CASE WHEN p.n % 2 = 0 THEN CASE WHEN i <= m THEN b ELSE a END WHEN i <= m THEN (b + c) / 2 WHEN i = m + 1 THEN (a + c) / 2 ELSE (a + b) / 2 END AS rep FROM o, p)
SELECT 'median' AS statistic, any_value(n) AS n, round(any_value(theta), 4) AS estimate, round((any_value(n) - 1) * avg(rep - theta), 4) + 0.0 AS bias, round(sqrt((any_value(n) - 1.0) * var_pop(rep - theta)), 4) + 0.0 AS std_err FROM r""")
def _jackknife_median(spark, d):
    return _round(resample.jackknife(_t(spark, d, "events"), "value", "median"), ["statistic", "n", "estimate", "bias", "std_err"])


@query("jackknife_regression", """
WITH m AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) AS sxx, regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0 FROM lineitem),
e AS (SELECT n, mx, sxx, b0, b1, l_quantity AS x, (l_extendedprice - b0 - b1 * l_quantity) / (1 - 1 / n - (l_quantity - mx)^2 / sxx) AS s FROM lineitem, m),
r AS (SELECT n, b0, b1, -(x - mx) / sxx * s AS m1, -(1 / n - mx * (x - mx) / sxx) * s AS m0 FROM e)
SELECT 'const' AS term, round(any_value(b0), 3) AS coef, round(stddev_samp(m0) * sqrt((any_value(n) - 1)^2 / any_value(n)), 3) AS std_err FROM r
UNION ALL SELECT 'l_quantity', round(any_value(b1), 3), round(stddev_samp(m1) * sqrt((any_value(n) - 1)^2 / any_value(n)), 3) FROM r""")
def _jackknife_regression(spark, d):
    return _round(resample.jackknife_regression(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]), ["term", "coef", "std_err"], 3)


def _bootstrap_sql(table: str, column: str, key: str, n_boot: int, seed: int) -> str:
    """The weights again, from 64-bit products taken modulo 2^64."""
    mixed = lambda z: f"xor(m2, m2 // 2147483648::UBIGINT) AS {z}"
    times = lambda a, b: f"((({a})::UHUGEINT * {b}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    plus = lambda a, b: f"((({a})::UHUGEINT + ({b})::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    golden, a, b = resample.GOLDEN, resample.MIX_A, resample.MIX_B

    def mix(name: str, source: str, keep: str) -> str:
        return f"""
{name}a AS (SELECT {keep}, {times("xor(z, z // 1073741824::UBIGINT)", a)} AS m1 FROM {source}),
{name}b AS (SELECT {keep}, {times("xor(m1, m1 // 134217728::UBIGINT)", b)} AS m2 FROM {name}a),
{name} AS (SELECT {keep}, {mixed("z")} FROM {name}b),"""

    count = "CASE " + " ".join(f"WHEN u < {s} THEN {k}" for k, s in enumerate(resample.poisson_steps())) + f" ELSE {len(resample.poisson_steps())} END"
    return f"""
WITH o AS (SELECT {column}::DOUBLE AS x, {key} AS place FROM {table}),
i AS (SELECT x, {plus("place::UBIGINT", f"{seed * golden % 2**64}")} AS z FROM o),{mix("r", "i", "x")}
g AS (SELECT x, k, {plus("z", f"{times('(k + 1)', golden)}")} AS z FROM r, (SELECT unnest(range({-(-n_boot // 4)})) AS k)),{mix("h", "g", "x, k")}
l AS (SELECT x, 4 * k + lane AS b, (z // (65536::UBIGINT ** lane)::UBIGINT) % 65536 AS u FROM h, (SELECT unnest(range(4)) AS lane)),
w AS (SELECT x, b, {count} AS w FROM l WHERE b < {n_boot}),
p AS (SELECT b, sum(w * x) / sum(w) AS rep FROM w GROUP BY b HAVING sum(w) > 0),
t AS (SELECT avg(x) AS theta, count(*) AS n FROM o)
SELECT 'mean' AS statistic, any_value(n) AS n, {n_boot}::INT AS n_boot, round(any_value(theta), 2) AS estimate, round(avg(rep) - any_value(theta), 2) + 0.0 AS bias, round(stddev_samp(rep), 2) AS std_err,
       round(quantile_cont(rep, 0.025), 2) AS ci_low, round(quantile_cont(rep, 0.975), 2) AS ci_high, round(min(rep), 2) AS replicate_min, round(max(rep), 2) AS replicate_max FROM p, t"""


@query("bootstrap_mean", _bootstrap_sql("lineitem", "l_extendedprice", "row_number() OVER (ORDER BY l_extendedprice) - 1", 500, 42))
def _bootstrap(spark, d):
    out = resample.bootstrap(_t(spark, d, "lineitem"), "l_extendedprice", "mean", 500, 42)
    return _round(out, ["statistic", "n", "n_boot", "estimate", "bias", "std_err", "ci_low", "ci_high", "replicate_min", "replicate_max"], 2)


@query("bootstrap_mean_by_key", _bootstrap_sql("events", "value", "event_id", 400, 7))
def _bootstrap_by_key(spark, d):
    out = resample.bootstrap(_t(spark, d, "events"), "value", "mean", 400, 7, "event_id")
    return _round(out, ["statistic", "n", "n_boot", "estimate", "bias", "std_err", "ci_low", "ci_high", "replicate_min", "replicate_max"], 2)


@query("bootstrap_median")
def _bootstrap_median(spark, d):
    return resample.bootstrap(_t(spark, d, "events"), "value", "median", 1000, 42)


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _flags(first: int) -> str:
    return "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INT AS \"o_orderstatus_{v}\"" for v in ["F", "O", "P"][first:]) + " FROM orders"


@query("one_hot_encode", _flags(0))
def _one_hot(spark, d):
    return encode.one_hot_encode(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("dummy_encode", _flags(1))
def _dummy(spark, d):
    return encode.dummy_encode(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("ordinal_encode", "SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type DESC) - 1 AS code FROM events")
def _ordinal(spark, d):
    events = _t(spark, d, "events").select("event_id", "event_type")
    order = ["view", "signup", "purchase", "error", "click"]
    return encode.ordinal_encode(events, "event_type", order, "code").withColumn("code", F.col("code").cast("long"))


@query("label_encode", "SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def _label(spark, d):
    return encode.label_encode(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code").withColumn("code", F.col("code").cast("long"))


@query("target_encode", """
WITH g AS (SELECT event_type, avg(value) AS m, count(value) AS n FROM events GROUP BY 1), a AS (SELECT avg(value) AS m FROM events)
SELECT event_id, event_type, round(g.n / (g.n + 10.0) * g.m + 10.0 / (g.n + 10.0) * a.m, 4) AS code FROM events JOIN g USING (event_type), a""")
def _target(spark, d):
    out = encode.target_encode(_t(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "value", 10.0, "code")
    return out.select("event_id", "event_type", rounded(F.col("code")).alias("code"))


@query("box_cox_transform")
def _box_cox(spark, d):
    out, found = transform.box_cox_transform(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", output="transformed")
    return out.withColumns({k: F.lit(v) for k, v in found.items()})


@query("box_cox_likelihoods", " UNION ALL ".join(
    f"SELECT {e}::DOUBLE AS exponent, round(-count(*) / 2.0 * ln(var_pop({'z' if e == 0 else f'(exp({e} * z) - 1) / {e}'})), 4) + 0.0 AS likelihood FROM (SELECT ln(o_totalprice) - avg(ln(o_totalprice)) OVER () AS z FROM orders)"
    for e in transform.PLAIN))
def _box_cox_likelihoods(spark, d):
    return _round(transform.box_cox_likelihoods(_t(spark, d, "orders"), "o_totalprice"), ["exponent", "likelihood"])


@query("label_encode_names", "SELECT c_custkey, c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS code FROM customer")
def _label_names(spark, d):
    return encode.label_encode(_t(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "code").withColumn("code", F.col("code").cast("long"))


@query("train_test_split_by_name", "SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS row_index, CASE WHEN row_number() OVER (ORDER BY c_name) - 1 < floor(count(*) OVER () * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM customer")
def _split_names(spark, d):
    return split.train_test_split(_t(spark, d, "customer").select("c_name"), "c_name")


_INDEX = "SELECT event_id, row_number() OVER (ORDER BY {o}) - 1 AS row_index, (SELECT count(*) FROM events) AS n FROM events"


@query("train_test_split", f"SELECT event_id, row_index, CASE WHEN row_index < floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM ({_INDEX.format(o='event_id')})")
def _split(spark, d):
    return split.train_test_split(_t(spark, d, "events").select("event_id"), "event_id")


@query("train_test_split_shuffled", f"SELECT event_id, row_index, CASE WHEN row_index < floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM ({_INDEX.format(o=chr(39).join(['md5(', '42|', ' || event_id)']))})")
def _split_shuffled(spark, d):
    return split.train_test_split(_t(spark, d, "events").select("event_id"), "event_id", random_state=42, shuffle=True)


@query("train_validation_test_split", f"SELECT event_id, row_index, CASE WHEN row_index < floor(n * (1 - 0.1::DOUBLE - 0.2::DOUBLE)) THEN 'train' WHEN row_index < floor(n * (1 - 0.2::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM ({_INDEX.format(o='event_id')})")
def _split3(spark, d):
    return split.train_validation_test_split(_t(spark, d, "events").select("event_id"), "event_id")


def _hourly(spark, d) -> DataFrame:
    return _t(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("total"))


def _daily(spark, d) -> DataFrame:
    return _t(spark, d, "orders").groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("price"))


@query("check_stationarity", series_sql.stationarity_sql())
def _stationarity(spark, d):
    out = stationarity.check_stationarity(_hourly(spark, d), "event_type", "hour", "total")
    return _round(out.withColumn("adf_aic", F.round("adf_aic", 3)), ["series", "n", "adf", "adf_lags", "adf_aic", "kpss", "kpss_lags", "kpss_p"])


_STL = (24, *decomposition.spans(24))


@query("decompose_time_series", series_sql.stl_sql(*_STL, "SELECT series, moment AS \"at\", round(observed, 4) AS observed, round(trend, 4) + 0.0 AS trend, round(seasonal, 4) + 0.0 AS seasonal, round(residual, 4) + 0.0 AS residual FROM parts"))
def _decompose(spark, d):
    out = decomposition.decompose_time_series(_hourly(spark, d), "event_type", "hour", "total", 24)
    return _round(out, ["series", "at", "observed", "trend", "seasonal", "residual"])


_STRENGTH = "round(greatest(0, 1 - var_samp(residual) / var_samp(residual + {0})), 4) AS {0}_strength"


@query("decompose_strengths", series_sql.stl_sql(*_STL, f"SELECT series, {_STRENGTH.format('trend')}, {_STRENGTH.format('seasonal')}, count(*) AS n FROM parts GROUP BY series"))
def _strengths(spark, d):
    out = decomposition.decompose_time_series(_hourly(spark, d), "event_type", "hour", "total", 24)
    return _round(out.groupBy("series").agg(F.max("trend_strength").alias("trend_strength"), F.max("seasonal_strength").alias("seasonal_strength"), F.count("*").alias("n")), ["series", "trend_strength", "seasonal_strength", "n"])


@query("fit_arima_autoregression", series_sql.ar1_sql())
def _autoregression(spark, d):
    out = timeseries.fit_arima_model(_hourly(spark, d), "event_type", "hour", "total", (1, 0, 0))
    return out.select("series", "n", rounded(F.col("coef")[0], 3).alias("const"), rounded(F.col("coef")[1]).alias("ar"), rounded(F.col("sigma2"), 2).alias("sigma2"), rounded(F.col("llf"), 3).alias("llf"))


@query("fit_arima_model")
def _arima(spark, d):
    return timeseries.fit_arima_model(_daily(spark, d), "o_orderpriority", "month", "price")


@query("forecast_time_series")
def _forecast(spark, d):
    return timeseries.forecast_time_series(timeseries.fit_arima_model(_daily(spark, d), "o_orderpriority", "month", "price"), 10)


@query("windowed_moments", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 4) + 0.0 AS mean, round(stddev_samp(value), 4) + 0.0 AS sd FROM events GROUP BY ALL")
def _windowed(spark, d):
    out = windowed_moments(_t(spark, d, "events"), "ts", "value", ["event_type"])
    return _round(out, ["window_start", "event_type", "n", "mean", "sd"])
