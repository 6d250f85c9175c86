"""Operators on small seeded frames with missing values, against numpy and known structure."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import checks, describe, encode, nonparametric, parametric, regression, resample, selection, split, timeseries, transform
from statloom.sources.io import profile_dataset, read_dataset, write_dataset

RNG = np.random.default_rng(42)


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.fixture(scope="module")
def two_groups(spark):
    x = np.concatenate([RNG.normal(10, 2, 60), RNG.normal(12, 2, 60), [np.nan, 5.0]])
    return frame(spark, value=x, group=["A"] * 60 + ["B"] * 60 + ["A", None]), x[:60], x[60:120]


def test_describe_and_missing_values(spark):
    df = frame(spark, a=[1.0, 2.0, np.nan, 4.0], b=[1, 2, 3, 4], c=list("wxyz"))
    rows = {r["column"]: r for r in describe.describe(df).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["count"] == 3 and rows["a"]["mean"] == 2.3333 and rows["a"]["q50"] == 2.0
    with pytest.raises(ValueError, match="not numeric"):
        describe.describe(df, ["c"])


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_is_pairwise_complete(spark, method):
    a, b = RNG.normal(size=30), RNG.normal(size=30)
    c = a + b
    c[3] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    expected = pdf.corr("pearson") if method == "pearson" else pd.DataFrame({x: {y: pdf[[x, y]].dropna().rank().corr().iloc[0, -1] if x != y else 1.0 for y in pdf} for x in pdf})
    for r in describe.correlation_matrix(spark.createDataFrame(pdf), ["a", "b", "c"], method).collect():
        assert r["correlation"] == pytest.approx(expected.loc[r["column_a"], r["column_b"]], abs=1e-4)


def test_two_sample_welch(two_groups):
    df, a, b = two_groups
    r = parametric.two_sample_t_test(df, "group", "value").first()
    t = (a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 60 + b.var(ddof=1) / 60)
    assert r["t"] == pytest.approx(t) and r["p_value"] < 1e-4 and r["n_a"] == 60
    assert r["ci_low"] < r["difference"] < r["ci_high"]


def test_two_groups_are_needed(spark):
    with pytest.raises(Exception, match="exactly two"):
        parametric.two_sample_t_test(frame(spark, v=[1.0, 2.0], g=["a", "a"]), "g", "v").collect()


def test_anova_eta_and_fallback(spark):
    x = np.concatenate([RNG.normal(m, 1, 50) for m in (0, 5, 10)])
    r = parametric.one_way_anova(frame(spark, v=x, g=np.repeat(list("abc"), 50)), "g", "v").first()
    assert r["p_value"] < 1e-3 and r["eta_squared"] > 0.5
    skewed = RNG.exponential(1, 150)
    r = parametric.one_way_anova(frame(spark, v=skewed, g=np.repeat(list("abc"), 50)), "g", "v").first()
    assert not r["assumptions_met"] and r["recommended_alternative"] == "kruskal_wallis_test"


def test_tukey_finds_the_shifted_group(spark):
    x = np.concatenate([RNG.normal(m, 1, 40) for m in (0, 0, 3)])
    rows = parametric.pairwise_tukey_posthoc(frame(spark, v=x, g=np.repeat(list("abc"), 40)), "g", "v").collect()
    assert {(r["group1"], r["group2"]) for r in rows if r["reject"]} == {("a", "c"), ("b", "c")}


def test_shapiro_published_example():
    w, p = checks.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.002)


def test_normality_by_group(spark):
    df = frame(spark, g=["n"] * 200 + ["e"] * 200 + ["s"] * 2, x=np.concatenate([RNG.normal(size=200), RNG.exponential(1, 200), [1, 2]]))
    got = {r["g"]: r for r in checks.normality_check(df, "x", ["g"]).collect()}
    assert got["n"]["passed"] and not got["e"]["passed"] and not got["s"]["passed"] and got["s"]["statistic"] is None


def test_moment_test_is_used_for_large_groups(spark):
    r = checks.normality_check(spark.range(6000).select(F.randn(1).alias("x")), "x").first()
    assert r["test"] == "dagostino_pearson" and r["p_value"] > 0.001


def test_mann_whitney_exact_and_ties(spark):
    df = frame(spark, v=[1.0, 2, 3, 4, 5, 6], g=list("aaabbb"))
    r = nonparametric.mann_whitney_u_test(df, "g", "v").first()
    assert r["u"] == 0 and r["p_value"] == pytest.approx(2 / 20)
    x, y = RNG.integers(1, 6, 40), RNG.integers(2, 7, 40)
    r = nonparametric.mann_whitney_u_test(frame(spark, v=np.concatenate([x, y]), g=["a"] * 40 + ["b"] * 40), "g", "v").first()
    assert r["u"] == sum((p > q) + 0.5 * (p == q) for p in x for q in y)


def test_wilcoxon_exact_by_enumeration(spark):
    d = np.array([0.3, -0.7, 1.1, 2.0, -0.2, 3.1, 0.9])
    r = nonparametric.wilcoxon_signed_rank_test(frame(spark, a=d, b=np.zeros(7)), "a", "b").first()
    ranks = np.abs(d).argsort().argsort() + 1
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    below = sum(sum(s) <= w for s in itertools.product(*[(0, k) for k in ranks]))
    assert r["w"] == w and r["p_value"] == pytest.approx(min(1, 2 * below / 2**7))


def test_kruskal_and_chi_square(spark):
    df = frame(spark, v=np.concatenate([RNG.exponential(s, 30) for s in (1, 5, 10)]), g=np.repeat(list("abc"), 30))
    assert nonparametric.kruskal_wallis_test(df, "g", "v").first()["p_value"] < 0.01
    x = ["yes"] * 90 + ["no"] * 10 + ["yes"] * 10 + ["no"] * 90
    r = nonparametric.chi_square_test_independence(frame(spark, x=x, y=["A"] * 100 + ["B"] * 100), "x", "y").first()
    assert r["df"] == 1 and r["chi2"] == pytest.approx(200 * (8000 - 100) ** 2 / 1e8, rel=1e-9) and r["cramers_v"] > 0.5
    with pytest.raises(Exception, match="as many weights"):
        nonparametric.chi_square_goodness_of_fit(frame(spark, x=list("aab")), "x", [1, 1, 1]).collect()


@pytest.fixture(scope="module")
def known(spark):
    x = RNG.normal(size=(200, 4))
    y = 5 + 2 * x[:, 0] + 3 * x[:, 1] + RNG.normal(size=200)
    return frame(spark, y=y, **{f"x{i + 1}": x[:, i] for i in range(4)}), x, y


def test_ols_equals_least_squares(spark):
    x = 1e6 + RNG.normal(size=300)
    y = 3 + 2 * (x - 1e6) + RNG.normal(0, 0.1, 300)
    fit = regression.linear_regression(frame(spark, x=x, y=y), "y", ["x", "x"]).fit
    assert fit.coef[1] == pytest.approx(2, abs=0.02) and fit.r_squared > 0.99


@pytest.mark.parametrize("criterion", selection.CRITERIA)
def test_selection_recovers_structure(known, criterion):
    df = known[0]
    names = ["x1", "x2", "x3", "x4"]
    result, steps = selection.forward_selection(df, "y", names, criterion, max_predictors=2)
    assert [r["predictor"] for r in steps.sort("step").collect()] == ["x2", "x1"]
    _, chosen = selection.best_subset_selection(df, "y", names, criterion, max_predictors=2)
    assert set(chosen) == {"x1", "x2"}


def test_selection_guards(spark, known):
    with pytest.raises(ValueError, match="criterion"):
        selection.forward_selection(known[0], "y", ["x1"], "other")
    with pytest.raises(ValueError, match="50000"):
        wide = frame(spark, y=RNG.normal(size=200), **{f"z{i}": RNG.normal(size=200) for i in range(18)})
        selection.best_subset_selection(wide, "y", [f"z{i}" for i in range(18)])


def test_weights_restore_homoscedasticity(spark):
    x = RNG.uniform(1, 10, 300)
    df = frame(spark, x=x, y=2 + 3 * x + RNG.normal(0, 0.5 * x), w=1 / (0.5 * x) ** 2)
    assert regression.linear_regression(df, "y", ["x"]).summary.first()["breusch_pagan_p"] < 0.05
    assert regression.weighted_linear_regression(df, "y", ["x"], "w").summary.first()["breusch_pagan_p"] > 0.01
    result, rounds, done = regression.irls_regression(df, "y", ["x"])
    assert done and rounds >= 1 and result.fit.coef[1] == pytest.approx(3, abs=0.2)
    with pytest.raises(ValueError, match="positive"):
        regression.weighted_linear_regression(df.withColumn("w", F.lit(-1.0)), "y", ["x"], "w")


def test_logistic(spark):
    x = RNG.normal(size=400)
    y = (RNG.random(400) < 1 / (1 + np.exp(-4 * x))).astype(int)
    r = regression.logistic_regression(frame(spark, x=x, y=y), "y", ["x"])
    assert r.summary.first()["mcfadden"] > 0.3 and r.coefficients.where("term = 'x'").first()["odds_ratio"] > 5


def test_durbin_watson_any_partitioning(spark):
    e = RNG.normal(size=500)
    wanted = (np.diff(e) ** 2).sum() / (e**2).sum()
    df = frame(spark, t=np.arange(500), e=e)
    for n in (1, 7):
        assert checks.durbin_watson(df.repartition(n), "e", "t").first()["statistic"] == pytest.approx(wanted)


@pytest.mark.parametrize("statistic", ["mean", "median", "std", "var"])
@pytest.mark.parametrize("n", [60, 61])
def test_jackknife_equals_brute_force(spark, statistic, n):
    x = np.round(RNG.exponential(5, n), 1)
    fn = getattr(np, statistic)
    reps = np.array([fn(np.delete(x, i)) for i in range(n)])
    r = resample.jackknife(frame(spark, x=x), "x", statistic).first()
    assert r["estimate"] == pytest.approx(fn(x))
    assert r["bias"] == pytest.approx((n - 1) * (reps.mean() - fn(x)), abs=1e-8)
    assert r["std_err"] == pytest.approx(math.sqrt((n - 1) / n * ((reps - reps.mean()) ** 2).sum()), abs=1e-8)


def test_jackknife_regression_equals_refits(spark, known):
    df, x, y = known
    design = np.column_stack([np.ones(200), x[:, :2]])
    reps = np.array([np.linalg.lstsq(np.delete(design, i, 0), np.delete(y, i), rcond=None)[0] for i in range(200)])
    rows = {r["term"]: r for r in resample.jackknife_regression(df, "y", ["x1", "x2"]).collect()}
    for i, term in enumerate(["const", "x1", "x2"]):
        assert rows[term]["std_err"] == pytest.approx(reps[:, i].std(ddof=1) * math.sqrt(199**2 / 200), rel=1e-6)


@pytest.mark.parametrize("statistic", ["mean", "median", "std"])
def test_bootstrap_matches_theory(spark, statistic):
    df = spark.range(5000).select((F.randn(3) * 10 + 50).alias("x"))
    r = resample.bootstrap(df, "x", statistic, 400, 1).first()
    se = {"mean": 1, "median": 1.2533, "std": 1 / math.sqrt(2)}[statistic] * 10 / math.sqrt(5000)
    assert r["std_err"] == pytest.approx(se, rel=0.2) and r["ci_low"] < r["estimate"] < r["ci_high"]
    with pytest.raises(ValueError, match="n_boot"):
        resample.bootstrap(df, "x", statistic, 0)


@pytest.mark.parametrize("statistic", ["mean", "median", "var"])
def test_bootstrap_does_not_depend_on_partitions(spark, statistic):
    pdf = pd.DataFrame({"id": np.arange(900), "x": np.round(RNG.normal(5, 2, 900), 1)})
    runs = [resample.bootstrap(df, "x", statistic, 60, 5, key).first().asDict() for key in (None, "id") for df in (spark.createDataFrame(pdf), spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(9))]
    for a, b in (runs[:2], runs[2:]):
        assert all(a[k] == (pytest.approx(b[k], rel=1e-12) if isinstance(a[k], float) else b[k]) for k in a)
    with pytest.raises(ValueError, match="whole numbers"):
        resample.bootstrap(spark.createDataFrame(pdf), "x", statistic, 10, 1, "x")


def test_bootstrap_of_tiny_samples(spark):
    r = resample.bootstrap(frame(spark, x=[1.0, 2.0]), "x", "mean", 200, 3).first()
    assert r["n"] == 2 and 1 <= r["replicate_min"] < r["replicate_max"] <= 2 and not r["size_ok"]


def test_weights_are_poisson_and_independent():
    table = np.searchsorted(resample.poisson_steps(), np.arange(1 << 16), "right").astype(float)
    w = resample._weights(np.arange(2000) + 2**40, np.arange(100), 9, table)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert np.abs(np.corrcoef(w[:, :60].T) - np.eye(60)).max() < 0.12 and np.abs(np.corrcoef(w[:60]) - np.eye(60)).max() < 0.3


def test_encoders(spark):
    df = frame(spark, c=["b", "a", None, "b"], y=[1.0, 3.0, 5.0, 2.0])
    assert encode.one_hot_encode(df, ["c"]).columns == ["y", "c_a", "c_b"]
    assert [tuple(r)[1:] for r in encode.one_hot_encode(df, ["c"]).sort("y").collect()] == [(0, 1), (0, 1), (1, 0), (0, 0)]
    assert encode.dummy_encode(df, ["c"]).columns == ["y", "c_b"]
    assert [r["c_encoded"] for r in encode.label_encode(df, "c").sort("y").collect()] == [1, 1, 0, None]
    assert [r["c_encoded"] for r in encode.ordinal_encode(df, "c", ["z", "b", "a"]).sort("y").collect()] == [1, 1, 2, None]
    assert [r["c_encoded"] for r in encode.target_encode(df, "c", "y").sort("y").collect()] == [1.5, 1.5, 3.0, None]
    with pytest.raises(ValueError, match="lacks"):
        encode.ordinal_encode(df, "c", ["a"])


def test_box_cox_finds_the_logarithm(spark):
    y = np.exp(RNG.normal(5, 1, 500))
    out, found = transform.box_cox_transform(frame(spark, y=y), "y")
    assert found["lambda"] == 0 and found["ci_low"] < 0 < found["ci_high"]
    assert out.where(F.abs(F.col("y_boxcox") - F.log("y")) > 1e-9).count() == 0
    with pytest.raises(ValueError, match="positive"):
        transform.box_cox_transform(frame(spark, y=[1.0, -1.0]), "y")


def test_splits_are_exact_and_reproducible(spark):
    df = spark.range(100).withColumnRenamed("id", "a").repartition(7)
    parts = split.train_test_split(df, "a")
    assert [r["a"] for r in parts.where("split = 'train'").sort("a").collect()] == list(range(80))
    shuffled = [sorted(r["a"] for r in split.train_test_split(d, "a", random_state=3, shuffle=True).where("split = 'test'").collect()) for d in (df, df.repartition(3))]
    assert shuffled[0] == shuffled[1] != list(range(80, 100))
    three = {r["split"]: r["n"] for r in split.train_validation_test_split(df, "a").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert three == {"train": 70, "validation": 10, "test": 20}
    with pytest.raises(ValueError):
        split.train_test_split(df, "a", 1.5)


def test_time_series(spark):
    t = np.arange(120)
    pdf = pd.concat(
        [
            pd.DataFrame({"k": "noise", "t": t, "x": RNG.normal(size=120)}),
            pd.DataFrame({"k": "season", "t": t, "x": 5 * np.sin(2 * np.pi * t / 12) + RNG.normal(0, 0.2, 120)}),
            pd.DataFrame({"k": "walk", "t": t, "x": np.cumsum(RNG.normal(size=120))}),
        ]
    )
    df = spark.createDataFrame(pdf)
    tests = {r["series"]: r for r in timeseries.check_stationarity(df, "k", "t", "x").collect()}
    assert tests["noise"]["adf_stationary"] and not tests["walk"]["adf_stationary"]
    parts = timeseries.decompose_time_series(df, "k", "t", "x", 12)
    assert parts.where("series = 'season'").first()["seasonal_strength"] > 0.9
    assert parts.where(F.abs(F.col("trend") + F.col("seasonal") + F.col("residual") - F.col("observed")) > 1e-9).count() == 0
    models = timeseries.fit_arima_model(df, "k", "t", "x", (1, 0, 0))
    noise = models.where("series = 'noise'").first()
    assert abs(noise["coef"][1]) < 0.3 and noise["terms"] == ["const", "ar.L1"]
    steps = timeseries.forecast_time_series(models, 5).where("series = 'noise'").sort("step").collect()
    assert len(steps) == 5 and all(s["ci_lower"] < s["forecast"] < s["ci_upper"] for s in steps)


def test_arima_recovers_coefficients():
    e = np.random.default_rng(0).normal(size=800)
    y = np.zeros(800)
    for i in range(1, 800):
        y[i] = 0.7 * y[i - 1] + e[i] + 0.4 * e[i - 1]
    m = timeseries.fit_arima(y, (1, 0, 1))
    assert m["coef"][1] == pytest.approx(0.7, abs=0.08) and m["coef"][2] == pytest.approx(0.4, abs=0.08)


def test_sources(spark, tmp_path):
    df = frame(spark, a=[1, 2, 3], b=["x", None, "z"])
    write_dataset(df, str(tmp_path / "t.parquet"))
    assert read_dataset(spark, str(tmp_path / "t.parquet")).count() == 3
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "t.json").write_text('[{"a": 1}, {"a": 2}]')
    assert read_dataset(spark, str(tmp_path / "t.csv")).dtypes[0] == ("a", "int")
    assert read_dataset(spark, str(tmp_path / "t.json")).count() == 2
    assert [r["n_values"] for r in profile_dataset(df).sort("position").collect()] == [3, 2]
    with pytest.raises(ValueError, match="unknown file type"):
        read_dataset(spark, "t.xlsx")


@pytest.fixture(scope="module")
def useful_and_noise(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 4))
    return frame(spark, **{f"x{i}": x[:, i] for i in range(4)}, y=3 * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 0.5, 300)), x


@pytest.mark.parametrize("criterion", ["aic", "bic", "r_squared", "mallows_cp", "p_value"])
def test_backward_elimination_drops_noise(useful_and_noise, criterion):
    df, _ = useful_and_noise
    result, steps = selection.backward_elimination(df, "y", ["x0", "x1", "x2", "x3"], criterion=criterion)
    gone = [r["predictor"] for r in steps.sort("step").collect()]
    assert gone and set(gone) <= {"x2", "x3"} and {"x0", "x1"} <= {r["term"] for r in result.coefficients.collect()}


def test_backward_elimination_steps_lower_the_criterion(useful_and_noise):
    df, x = useful_and_noise
    y = np.array([r["y"] for r in df.select("y").collect()])

    def bic(cols):
        design = np.column_stack([np.ones(300), x[:, cols]])
        e = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
        return 300 * (math.log(2 * math.pi) + math.log(e @ e / 300) + 1) + (len(cols) + 1) * math.log(300)

    steps = selection.backward_elimination(df, "y", ["x0", "x1", "x2", "x3"], criterion="bic")[1].sort("step").collect()
    left = [0, 1, 2, 3]
    for r in steps:
        scores = {f"x{i}": bic([j for j in left if j != i]) for i in left}
        assert r["predictor"] == min(scores, key=scores.get) and r["score"] == pytest.approx(min(scores.values()), abs=1e-6)
        left.remove(int(r["predictor"][1]))
    assert all(bic([j for j in left if j != i]) >= bic(left) for i in left)


def test_backward_elimination_refusals(spark, useful_and_noise):
    df, _ = useful_and_noise
    with pytest.raises(ValueError, match="did not remove"):
        selection.backward_elimination(df, "y", ["x0", "x1"])
    with pytest.raises(ValueError):
        selection.backward_elimination(df, "y", [])
    with pytest.raises(ValueError):
        selection.backward_elimination(df, "y", ["x0", "x2"], criterion="unheard of")
    rng = np.random.default_rng(3)
    result, steps = selection.backward_elimination(frame(spark, a=rng.normal(size=50), y=rng.normal(size=50)), "y", ["a"], criterion="bic")
    assert [r["predictor"] for r in steps.collect()] == ["a"] and result.terms == ["const"]
