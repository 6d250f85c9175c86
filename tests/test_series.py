"""Time-series operators: blocks against whole series in plain numpy, and published figures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.functions.ordering import blocks, placed
from statloom.operators import arima, decomposition, stationarity

#: Luteinizing hormone (48) and the flow of the Nile (100), published with R.
LH = [float(x) for x in "2.4 2.4 2.4 2.2 2.1 1.5 2.3 2.3 2.5 2.0 1.9 1.7 2.2 1.8 3.2 3.2 2.7 2.2 2.2 1.9 1.9 1.8 2.7 3.0 2.3 2.0 2.0 2.9 2.9 2.7 2.7 2.3 2.6 2.4 1.8 1.7 1.5 1.4 2.1 3.3 3.5 3.5 3.1 2.6 2.1 3.4 3.0 2.9".split()]
NILE = [float(x) for x in "1120 1160 963 1210 1160 1160 813 1230 1370 1140 995 935 1110 994 1020 960 1180 799 958 1140 1100 1210 1150 1250 1260 1220 1030 1100 774 840 874 694 940 833 701 916 692 1020 1050 969 831 726 456 824 702 1120 1100 832 764 821 768 845 864 862 698 845 744 796 1040 759 781 865 845 944 984 897 822 1010 771 676 649 846 812 742 801 1040 860 874 848 890 744 749 838 1050 918 986 797 923 975 815 1020 906 901 1170 912 746 919 718 714 740".split()]


def series(spark, **columns):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "t": np.arange(len(v)), "x": v}) for k, v in columns.items()])).repartition(7)


def test_places_and_blocks(spark):
    rows = spark.createDataFrame([("https://a/%05d" % (i * 7919 % 5000), "hot" if i % 3 else f"s{i % 11}", float(i)) for i in range(5000)], "at string, k string, x double").repartition(9)
    got = placed(rows, ["at"], ["k"], {"total": F.col("x"), "max_x": F.col("x")})
    pdf = rows.toPandas().sort_values(["k", "at"])
    pdf["place"] = pdf.groupby("k").cumcount()
    found = got.toPandas().sort_values(["k", "at"])
    assert found["place"].tolist() == pdf["place"].tolist()
    assert found["n"].tolist() == pdf.groupby("k")["x"].transform("size").tolist()
    assert found["total"].tolist() == pdf.groupby("k")["x"].transform("sum").tolist()
    for r in blocks(got, ["k", "n"], ["x"], 100, 30, 20).where("k = 'hot'").collect():
        whole = pdf[pdf["k"] == "hot"]["x"].to_numpy()
        a, b = max(0, r["block"] * 100 - 30), (r["block"] + 1) * 100 + 20
        assert r["first"] == a and r["x"] == whole[a:b].tolist()


def plain_adf(y):
    n, d = len(y), np.diff(y)
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))

    def fit(lag, skip):
        at = np.arange(skip, len(d))
        x = np.column_stack([y[at], np.ones(len(at)), *[d[at - i] for i in range(1, lag + 1)]])
        beta = np.linalg.lstsq(x, d[at], rcond=None)[0]
        e = d[at] - x @ beta
        return beta, e @ e, x

    aics = []
    for k in range(most + 1):
        _, ssr, x = fit(k, most)
        aics.append(len(x) * (math.log(2 * math.pi * ssr / len(x)) + 1) + 2 * (k + 2))
    lag = int(np.argmin(aics))
    beta, ssr, x = fit(lag, lag)
    return beta[0] / math.sqrt(ssr / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0]), lag, min(aics)


def plain_kpss(y):
    n, e = len(y), y - y.mean()
    s0, s1 = e @ e / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        c = e[i:] @ e[:-i] / (n / 2)
        s0, s1 = s0 + c, s1 + i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    variance = e @ e / n + 2 / n * sum((1 - i / (lags + 1)) * (e[i:] @ e[:-i]) for i in range(1, lags + 1))
    return (np.cumsum(e) ** 2).sum() / n**2 / variance, lags


def test_stationarity_over_blocks(spark):
    rng = np.random.default_rng(1)
    ar = np.zeros(20_000)
    for i, e in enumerate(rng.normal(size=20_000)):
        ar[i] = 0.6 * ar[i - 1] + e if i else e
    data = {"noise": 1e3 + rng.normal(size=8_192), "walk": np.cumsum(rng.normal(size=17_000)), "ar": ar, "lh": np.array(LH), "short": rng.normal(size=12), "long tail": rng.normal(size=8_200), "level": np.ones(40), "few": rng.normal(size=5)}
    got = {r["series"]: r for r in stationarity.check_stationarity(series(spark, **data), "k", "t", "x").collect()}
    assert set(got) == set(data) and got["level"]["adf"] is None and got["few"]["kpss"] is None and got["few"]["n"] == 5
    for k in set(data) - {"level", "few"}:
        tau, lag, aic = plain_adf(data[k])
        stat, lags = plain_kpss(data[k])
        assert (got[k]["adf_lags"], got[k]["kpss_lags"]) == (lag, lags)
        assert got[k]["adf"] == pytest.approx(tau, rel=1e-6) and got[k]["adf_aic"] == pytest.approx(aic, rel=1e-7) and got[k]["kpss"] == pytest.approx(stat, rel=1e-8)
    assert got["ar"]["adf_stationary"] and not got["walk"]["adf_stationary"] and not got["walk"]["kpss_stationary"]


def test_missing_keys_are_a_series(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(None if i % 2 else "a", i, float(v) if i % 10 else None) for i, v in enumerate(rng.normal(size=200))], "k string, t long, x double")
    rows = {r["series"]: r["n"] for r in stationarity.check_stationarity(df, "k", "t", "x").collect()}
    assert rows == {None: 100, "a": 80}
    assert decomposition.decompose_time_series(df, "k", "t", "x", 4).count() == 180


def plain_loess(y, span, at):
    n, q = len(y), min(span, len(y))
    out = []
    for x0 in at:
        first = min(max(round(x0) - q // 2, 0), n - q)
        x = np.arange(first, first + q)
        gap = np.abs(x - x0)
        h = gap.max() + max(span - n, 0) / 2
        w = np.where(gap < 0.001 * h, 1.0, np.where(gap < 0.999 * h, (1 - (gap / h) ** 3) ** 3, 0))
        a = np.column_stack([np.ones(q), x - x0]) * np.sqrt(w)[:, None]
        out.append(np.linalg.lstsq(a, y[x] * np.sqrt(w), rcond=None)[0][0])
    return np.array(out)


def plain_stl(y, period):
    n, trend = len(y), np.zeros(len(y))
    trend_span, low_span = decomposition.spans(period)
    for _ in range(5):
        cycle = np.zeros(n + 2 * period)
        for s in range(period):
            part = (y - trend)[s::period]
            cycle[s::period][: len(part) + 2] = plain_loess(part, 7, np.arange(-1, len(part) + 1))
        low = cycle
        for k in (period, period, 3):
            low = np.convolve(low, np.ones(k) / k, "valid")
        season = cycle[period : period + n] - plain_loess(low, low_span, range(n))
        trend = plain_loess(y - season, trend_span, range(n))
    return season, trend


@pytest.mark.parametrize("period, n", [(4, 900), (12, 130), (5, 11), (7, 1000)])
def test_decomposition_over_blocks(spark, monkeypatch, period, n):
    rng = np.random.default_rng(period)
    y = 50 + np.arange(n) * 0.02 + 3 * np.sin(2 * np.pi * np.arange(n) / period) + rng.normal(size=n)
    monkeypatch.setattr(decomposition, "LEAST_ROWS", 1)  # blocks as small as the reach allows
    got = decomposition.decompose_time_series(series(spark, a=y, b=y[: 2 * period - 1]), "k", "t", "x", period).toPandas().sort_values("at")
    season, trend = plain_stl(y, period)
    assert set(got["series"]) == {"a"} and got["at"].tolist() == list(range(n))
    assert np.abs(got["seasonal"].to_numpy() - season).max() < 1e-8 and np.abs(got["trend"].to_numpy() - trend).max() < 1e-8
    rest = y - season - trend
    assert got["seasonal_strength"].iloc[0] == pytest.approx(max(0, 1 - rest.var(ddof=1) / (rest + season).var(ddof=1)))


def test_wide_windows_are_the_same_by_transform():
    y = np.random.default_rng(3).normal(size=700)
    assert np.abs(decomposition.loess(y, 101) - plain_loess(y, 101, range(700))).max() < 1e-10


@pytest.mark.parametrize(
    "y, order, coef, errors, sigma2, llf",
    [
        (LH, (1, 0, 0), [2.4133, 0.5739], [0.1466, 0.1161], 0.1975, -29.38),
        (LH, (3, 0, 0), [2.3931, 0.6448, -0.0634, -0.2198], [0.0963, 0.1394, 0.1668, 0.1421], 0.1787, -27.09),
        (LH, (1, 0, 1), [2.4101, 0.4522, 0.1982], [0.1358, 0.1769, 0.1705], 0.1923, -28.76),
        (NILE, (1, 1, 1), [0.2544, -0.8741], [0.1194, 0.0605], 19769, -630.63),
    ],
)
@pytest.mark.parametrize("size", [8192, 20])
def test_arima_against_published_fits(y, order, coef, errors, sigma2, llf, size):
    m = arima.fit_arima(np.array(y), order, size)
    assert m["coef"] == pytest.approx(coef, abs=2e-4) and m["std_err"] == pytest.approx(errors, abs=1e-3)
    assert m["sigma2"] == pytest.approx(sigma2, rel=1e-3) and m["llf"] == pytest.approx(llf, abs=0.005)


def test_arima_of_long_series_over_blocks(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=20_100)
    y = np.zeros(20_100)
    for i in range(2, len(y)):
        y[i] = 0.5 * y[i - 1] - 0.3 * y[i - 2] + e[i] + 0.4 * e[i - 1]
    data = {"long": 20 + y[100:], "nile": np.array(NILE), "short": rng.normal(size=12)}
    models = arima.fit_arima_model(series(spark, **data), "k", "t", "x", (2, 0, 1))
    got = {r["series"]: r for r in models.collect()}
    assert set(got) == {"long", "nile"}
    # errors are below 0.02 at this length; three of them
    assert got["long"]["coef"] == pytest.approx([20, 0.5, -0.3, 0.4], abs=0.06) and max(got["long"]["std_err"][1:]) < 0.02 and got["long"]["sigma2"] == pytest.approx(1, abs=0.03)
    assert got["long"]["shocks"][-1] == pytest.approx(e[-1], abs=0.2)
    whole = arima.fit_arima(data["long"], (2, 0, 1), 1 << 15)
    assert got["long"]["coef"] == pytest.approx(whole["coef"], abs=1e-4) and got["long"]["llf"] == pytest.approx(whole["llf"], rel=1e-9)


def test_forecasts_of_a_known_model(spark):
    model = arima.fit_arima(np.array(LH), (3, 0, 0))
    steps = arima.forecast_path(model, 3, 0.05)
    # predict(arima(lh, order = c(3, 0, 0)), n.ahead = 3) of R
    assert [s[1] for s in steps] == pytest.approx([2.460173, 2.270829, 2.198597], abs=2e-3)
    psi = [1, 0.6448, 0.6448**2 - 0.0634]
    assert [(s[3] - s[1]) / 1.959964 for s in steps] == pytest.approx([math.sqrt(0.1787 * sum(v * v for v in psi[: h + 1])) for h in range(3)], abs=2e-3)
