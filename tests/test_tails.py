"""Tails as column expressions against the scalar functions and published values."""

import math

import pytest
from pyspark.sql import functions as F

from statloom.functions import dist, tails


def column(spark, rows, names, **cells):
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in rows], ", ".join(f"{n} double" for n in names))
    return df.select(*names, *[c.alias(k) for k, c in cells.items()]).collect()


def test_gamma_and_beta(spark):
    rows = [(a, b) for a in (0.5, 1, 2.5, 30, 1e4, 5e8) for b in (0.5, 1, 3.7, 200)]
    for r in column(spark, rows, "ab", g=tails.ln_gamma(F.col("a")), l=tails.ln_beta(F.col("a"), F.col("b"))):
        assert r["g"] == pytest.approx(math.lgamma(r["a"]), rel=1e-13, abs=1e-13)
        assert r["l"] == pytest.approx(math.lgamma(r["a"]) + math.lgamma(r["b"]) - math.lgamma(r["a"] + r["b"]), rel=1e-9, abs=1e-5 if r["a"] > 1e6 else 1e-9)


def test_tails(spark):
    rows = [(x, d) for x in (-3.0, -0.2, 0.0, 0.5, 1.96, 7.0) for d in (1, 2.5, 29, 5e4, 1e8)]
    for r in column(spark, rows, "xd", t=tails.t_sf(F.col("x"), F.col("d")), p=tails.t_p(F.col("x"), F.col("d")), less=tails.t_p(F.col("x"), F.col("d"), "less"), n=tails.norm_sf(F.col("x"))):
        rel = 1e-6 if r["d"] > 1e6 else 1e-9
        assert r["t"] == pytest.approx(dist.t_sf(r["x"], r["d"]), rel=rel, abs=1e-15)
        assert r["p"] == pytest.approx(dist.t_p(r["x"], r["d"]), rel=rel) and r["less"] == pytest.approx(dist.t_p(r["x"], r["d"], "less"), rel=rel, abs=1e-15)
        assert r["n"] == pytest.approx(dist.norm_sf(r["x"]), rel=1e-12)
    rows = [(x, a, b) for x in (0.01, 1.0, 3.84, 900.0) for a in (1, 4, 700) for b in (2, 33, 6e4)]
    for r in column(spark, rows, "xab", c=tails.chi2_sf(F.col("x"), F.col("a")), f=tails.f_sf(F.col("x"), F.col("a"), F.col("b"))):
        assert r["c"] == pytest.approx(dist.chi2_sf(r["x"], r["a"]), rel=1e-9, abs=1e-300)
        assert r["f"] == pytest.approx(dist.f_sf(r["x"], r["a"], r["b"]), rel=1e-8, abs=1e-300)


def test_quantiles_and_missing_arguments(spark):
    # Two-sided 5 % points of Student's t from tables
    table = {1: 12.706205, 2: 4.302653, 10: 2.228139, 30: 2.042272, 120: 1.979930}
    got = {r["d"]: r["q"] for r in column(spark, [(d,) for d in table], "d", q=tails.t_isf(0.025, F.col("d")))}
    assert got == pytest.approx(table, abs=1e-6)
    r = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x").select(tails.t_p(F.col("x"), F.lit(3.0)).alias("a"), tails.f_sf(F.col("x"), 2, 3).alias("b"), tails.chi2_sf(F.col("x"), 2).alias("c"), tails.t_isf(0.1, F.col("x")).alias("d")).first()
    assert list(r) == [None] * 4
