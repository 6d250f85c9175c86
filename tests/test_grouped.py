"""Regressions by key against one numpy fit a key."""

import math

import numpy as np
import pandas as pd
import pytest

from statloom.functions import dist
from statloom.operators import grouped, regression, resample


@pytest.fixture(scope="module")
def keyed(spark):
    """A hot key, a missing key, a key of three rows, one with constant predictors, missing values and large offsets."""
    rng = np.random.default_rng(8)
    sizes = {"hot": 3000, None: 60, "few": 3, "flat": 30, **{f"k{i}": 25 + i for i in range(40)}}
    parts = []
    for k, n in sizes.items():
        a, b = rng.normal(size=n) + 1e4, rng.normal(size=n) * 3
        if k == "flat":
            a[:] = 1.0
        y = 5 + 2 * a - b + rng.normal(size=n)
        parts.append(pd.DataFrame({"k": [k] * n, "a": a, "b": b, "y": y, "w": rng.uniform(0.5, 2, n), "z": (a - 1e4 - b / 3 + rng.normal(size=n) > 0).astype(int)}))
    pdf = pd.concat(parts).sample(frac=1, random_state=1).reset_index(drop=True)
    pdf.loc[::97, "a"] = np.nan
    return spark.createDataFrame(pdf).repartition(6), pdf.dropna(subset=["a"])


def groups(pdf):
    return [(None if isinstance(k, float) else k, g) for k, g in pdf.groupby("k", dropna=False)]


def rows_of(df):
    return {(r["k"], r["term"]): r for r in df.collect()}


@pytest.mark.parametrize("weights", [None, "w"])
def test_least_squares_of_each_key(keyed, weights):
    df, pdf = keyed
    got = rows_of(grouped.linear_regression_by(df, ["k"], "y", ["a", "b"], weights))
    assert len(got) == 3 * len(groups(pdf))
    for k, g in groups(pdf):
        if k == "few" or k == "flat":
            continue
        w = np.sqrt(g[weights].to_numpy() if weights else np.ones(len(g)))
        at = g["a"].mean()  # about the mean, as 1e4 squared leaves few digits
        x = np.column_stack([np.ones(len(g)), g["a"] - at, g["b"]])
        beta = np.linalg.lstsq(x * w[:, None], g["y"] * w, rcond=None)[0]
        e = (g["y"].to_numpy() - x @ beta) * w
        err = np.sqrt(np.diag(np.linalg.inv((x * w[:, None]).T @ (x * w[:, None]))) * (e @ e) / (len(g) - 3))
        assert [got[k, t]["coef"] for t in "ab"] == pytest.approx(beta[1:], rel=1e-6)
        assert got[k, "const"]["coef"] == pytest.approx(beta[0] - beta[1] * at, rel=1e-5)
        assert [got[k, t]["std_err"] for t in "ab"] == pytest.approx(err[1:], rel=1e-6)
        aux = np.linalg.lstsq(x, e * e, rcond=None)[0]
        r2 = 1 - ((e * e - x @ aux) ** 2).sum() / ((e * e - (e * e).mean()) ** 2).sum()
        assert got[k, "a"]["breusch_pagan"] == pytest.approx(len(g) * r2, rel=1e-5) and got[k, "a"]["n"] == len(g)
    assert got["few", "a"]["std_err"] is None or got["few", "a"]["df_resid"] <= 0
    assert got["flat", "a"]["coef"] == pytest.approx(0, abs=1e-9)


def test_a_key_fits_as_its_rows_alone(keyed):
    df, _ = keyed
    one = {r["term"]: r for r in regression.linear_regression(df.where("k = 'hot'"), "y", ["a", "b"]).coefficients.collect()}
    got = rows_of(grouped.linear_regression_by(df, ["k"], "y", ["a", "b"]))
    summary = regression.linear_regression(df.where("k = 'hot'"), "y", ["a", "b"]).summary.first()
    for t in "ab":
        assert got["hot", t]["coef"] == pytest.approx(one[t]["coef"], abs=1e-4) and got["hot", t]["p_value"] == pytest.approx(one[t]["p_value"], abs=1e-4)
    for name in ("r_squared", "f", "aic", "bic", "max_vif", "breusch_pagan"):
        assert got["hot", "a"][name] == pytest.approx(summary[name], rel=1e-6)
    jack = rows_of(grouped.jackknife_regression_by(df, ["k"], "y", ["a", "b"]))
    alone = {r["term"]: r for r in resample.jackknife_regression(df.where("k = 'hot'"), "y", ["a", "b"]).collect()}
    assert ("few", "a") not in jack
    for t in "ab":
        assert jack["hot", t]["std_err"] == pytest.approx(alone[t]["std_err"], rel=1e-5) and jack["hot", t]["ci_low"] == pytest.approx(alone[t]["ci_low"], rel=1e-5)


def plain_logit(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (p * (1 - p))[:, None]).T @ x
        beta = beta + np.linalg.solve(h, x.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(h))), float((y * np.log(p) + (1 - y) * np.log1p(-p)).sum())


def test_logistic_of_each_key(keyed):
    df, pdf = keyed
    got = rows_of(grouped.logistic_regression_by(df, ["k"], "z", ["a", "b"]))
    checked = 0
    for k, g in groups(pdf):
        if (k, "a") not in got or not got[k, "a"]["converged"] or k == "flat":
            continue
        x = np.column_stack([np.ones(len(g)), g["a"] - 1e4, g["b"]])
        beta, err, llf = plain_logit(x, g["z"].to_numpy())
        assert [got[k, t]["coef"] for t in "ab"] == pytest.approx(beta[1:], rel=1e-5) and [got[k, t]["std_err"] for t in "ab"] == pytest.approx(err[1:], rel=1e-5)
        assert got[k, "a"]["llf"] == pytest.approx(llf, rel=1e-8)
        checked += 1
    assert checked >= 35


def test_logistic_counts_equal_rows_once(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, 4000)
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(1 - 0.5 * x))).astype(int)
    r = regression.logistic_regression(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "y", ["x"])
    beta, err, llf = plain_logit(np.column_stack([np.ones(4000), x]), y)
    rows = {t["term"]: t for t in r.coefficients.collect()}
    assert [rows[t]["coef"] for t in ("const", "x")] == pytest.approx(beta, abs=1e-4) and [rows[t]["std_err"] for t in ("const", "x")] == pytest.approx(err, abs=1e-4)
    null = y.sum() * math.log(y.mean()) + (4000 - y.sum()) * math.log(1 - y.mean())
    assert r.summary.first()["lr_chi2"] == pytest.approx(2 * (llf - null), rel=1e-8)
    with pytest.raises(ValueError, match="no maximum"):
        regression.logistic_regression(spark.createDataFrame(pd.DataFrame({"x": np.arange(20.0), "y": [0] * 10 + [1] * 10})), "y", ["x"])


def test_refusals(keyed):
    df, _ = keyed
    with pytest.raises(ValueError, match="key"):
        grouped.linear_regression_by(df, [], "y", ["a"])
    with pytest.raises(ValueError, match="positive"):
        grouped.linear_regression_by(df.withColumn("w", df["w"] - 1), ["k"], "y", ["a"], "w")


def test_group_tests_of_each_key(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"k": ["hot"] * 900 + ["b"] * 60 + [None] * 40, "g": rng.choice(list("pqr"), 1000), "x": np.round(rng.normal(size=1000), 1)})
    pdf.loc[pdf["k"] == "b", "x"] += (pdf["g"] == "p") * 2
    pdf.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    anova = {r["k"]: r for r in grouped.one_way_anova_by(df, ["k"], "g", "x").collect()}
    kruskal = {r["k"]: r for r in grouped.kruskal_wallis_test_by(df, ["k"], "g", "x").collect()}
    for k, g in groups(pdf.dropna(subset=["x"])):
        parts = [v["x"].to_numpy() for _, v in g.groupby("g")]
        all_ = g["x"].to_numpy()
        between = sum(len(v) * (v.mean() - all_.mean()) ** 2 for v in parts)
        within = sum(((v - v.mean()) ** 2).sum() for v in parts)
        f = between / (len(parts) - 1) / (within / (len(all_) - len(parts)))
        assert anova[k]["f"] == pytest.approx(f) and anova[k]["n"] == len(all_) and anova[k]["p_value"] == pytest.approx(dist.f_sf(f, len(parts) - 1, len(all_) - len(parts)), rel=1e-8)
        ranks = g["x"].rank()
        n, t = len(all_), g["x"].value_counts().to_numpy(float)
        h = (12 / (n * (n + 1)) * sum(ranks[v.index].sum() ** 2 / len(v) for _, v in g.groupby("g")) - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))
        assert kruskal[k]["h"] == pytest.approx(h) and kruskal[k]["p_value"] == pytest.approx(dist.chi2_sf(h, len(parts) - 1), rel=1e-8)
