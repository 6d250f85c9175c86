"""Linear and logistic regression. These run jobs when called and return small frames."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.columns import complete, label, number, require, require_numeric
from statloom.functions.gram import Fit, Gram, gram, ols, uncentred_vif
from statloom.functions.scratch import written
from statloom.operators.checks import durbin_watson

VIF_LIMIT = 5.0


@dataclass
class Result:
    """``coefficients``: a row a term. ``summary``: one row of fit statistics and checks."""

    coefficients: DataFrame
    summary: DataFrame
    fit: Fit


def design(df: DataFrame, target: str, predictors: Sequence[str], *more: str) -> tuple[DataFrame, list[str]]:
    """Complete rows of target and predictors (repeated names once), as doubles."""
    predictors = list(dict.fromkeys(predictors))
    if not predictors:
        raise ValueError("needs at least one predictor")
    names = list(dict.fromkeys([target, *predictors, *more]))
    require_numeric(df, *names)
    return df.select(*[number(c).alias(c) for c in names]).dropna(), predictors


def predicted(fit: Fit) -> Column:
    out = F.lit(float(fit.coef[0]))
    for term, c in zip(fit.terms[1:], fit.coef[1:]):
        out = out + F.lit(float(c)) * F.col(term)
    return out


def breusch_pagan(rows: DataFrame, residual: Column, predictors: list[str]) -> tuple[float, float]:
    """Koenker's form: n times R squared of the squared residuals on the predictors, and its p-value."""
    fit = ols(gram(rows.withColumn("_e2", residual * residual), ["_e2", *predictors]), "_e2", predictors)
    stat = fit.n * fit.r_squared
    return stat, dist.chi2_sf(stat, fit.k - 1) if fit.k > 1 else math.nan


def _finish(df: DataFrame, rows: DataFrame, g: Gram, fit: Fit, target: str, predictors: list[str], weight: Column | None, order: str | None, alpha: float) -> Result:
    spark = df.sparkSession
    crit = dist.t_isf(0.025, fit.df_resid) if fit.df_resid > 0 else math.nan
    table = [
        (t, float(c), float(s), float(c / s) if s > 0 else None, float(p), float(c - crit * s), float(c + crit * s))
        for t, c, s, p in zip(fit.terms, fit.coef, fit.std_err, fit.p_values)
    ]
    coefficients = spark.createDataFrame([(r[0], *[None if v is None or v != v else round(v, 4) + 0.0 for v in r[1:]]) for r in table], "term string, coef double, std_err double, t double, p_value double, ci_lower double, ci_upper double")
    plain = gram(rows, [target, *predictors]) if weight is not None else g
    vif = uncentred_vif(plain, predictors)
    white = (F.col(target) - predicted(fit)) * (F.sqrt(weight) if weight is not None else F.lit(1.0))
    bp, bp_p = breusch_pagan(rows, white, predictors)
    dw = None
    if order:
        dw = durbin_watson(rows.withColumn("_res", white), "_res", order).first()["statistic"]
    f_p = dist.f_sf(fit.f, fit.k - 1, fit.df_resid) if fit.k > 1 and fit.df_resid > 0 and fit.f == fit.f else None
    row = (
        fit.f, f_p, float(fit.k - 1), float(fit.df_resid), fit.r_squared, fit.adj_r_squared, fit.aic, fit.bic, int(fit.n), float(max(vif)), bool(max(vif) <= VIF_LIMIT),
        bp, bp_p, bool(bp_p > 0.05), dw, None if dw is None else bool(1.5 <= dw <= 2.5), bool(fit.n >= 10 * len(predictors)), bool(max(vif) <= VIF_LIMIT and bp_p > 0.05), bool(f_p is not None and f_p < alpha),
    )
    schema = "f double, f_p_value double, df_model double, df_resid double, r_squared double, adj_r_squared double, aic double, bic double, n long, max_vif double, vif_ok boolean, breusch_pagan double, breusch_pagan_p double, homoscedastic boolean, durbin_watson double, independent boolean, size_ok boolean, assumptions_met boolean, significant boolean"
    clean = tuple(None if isinstance(v, float) and not math.isfinite(v) else float(v) if isinstance(v, float) else v for v in row)
    return Result(coefficients, spark.createDataFrame([clean], schema), fit)


def linear_regression(df: DataFrame, target: str, predictors: Sequence[str], alpha: float = 0.05, order_by: str | None = None) -> Result:
    """Ordinary least squares; coefficient intervals are 95 % whatever ``alpha``. ``order_by`` adds Durbin-Watson."""
    rows, predictors = design(df, target, predictors, *([order_by] if order_by else []))
    g = gram(rows, [target, *predictors])
    return _finish(df, rows, g, ols(g, target, predictors), target, predictors, None, order_by, alpha)


def weighted_linear_regression(df: DataFrame, target: str, predictors: Sequence[str], weights_column: str, alpha: float = 0.05, order_by: str | None = None) -> Result:
    """Weighted least squares; weights must be finite and positive."""
    rows, predictors = design(df, target, predictors, weights_column, *([order_by] if order_by else []))
    w = F.col(weights_column)
    if rows.where((w <= 0) | (F.abs(w) == float("inf"))).limit(1).count():
        raise ValueError("weights must be finite and positive")
    g = gram(rows, [target, *predictors], w)
    return _finish(df, rows, g, ols(g, target, predictors), target, predictors, w, order_by, alpha)


def irls_regression(df: DataFrame, target: str, predictors: Sequence[str], alpha: float = 0.05, max_iterations: int = 20, tol: float = 1e-3) -> tuple[Result, int, bool]:
    """Weights from a fit of the log squared residuals, until the coefficients settle: result, rounds, converged."""
    if max_iterations < 1:
        raise ValueError("max_iterations must be 1 or more")
    rows, predictors = design(df, target, predictors)
    rows = rows.persist()
    try:
        g = gram(rows, [target, *predictors])
        fit, weight, done, round_ = ols(g, target, predictors), None, False, 0
        while not done and round_ < max_iterations:
            round_ += 1
            e = F.col(target) - predicted(fit)
            variance = ols(gram(rows.withColumn("_v", F.log(e * e + 1e-8)), ["_v", *predictors]), "_v", predictors)
            weight = F.exp(-predicted(variance))
            g = gram(rows, [target, *predictors], weight)
            if not math.isfinite(g.weight):
                raise ValueError("weights are not finite")
            new = ols(g, target, predictors)
            done = all(abs(a - b) <= 1e-8 + tol * abs(b) for a, b in zip(new.coef, fit.coef))
            fit = new
        return _finish(df, rows, g, fit, target, predictors, weight, None, alpha), round_, done
    finally:
        rows.unpersist()


def vif(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Uncentred variance inflation of each predictor; above 5 is moderate, above 10 strong."""
    require_numeric(df, *predictors)
    names = list(dict.fromkeys(predictors))
    values = uncentred_vif(gram(df.select(*[number(c).alias(c) for c in names]).dropna(), names), names)
    rows = [(c, float(v), bool(v <= VIF_LIMIT), "strong" if v > 10 else "moderate" if v > VIF_LIMIT else "none") for c, v in zip(names, values)]
    return df.sparkSession.createDataFrame(rows, "predictor string, vif double, passed boolean, collinearity string")


def _logistic_step(cells: DataFrame, names: Sequence[str], centre: np.ndarray, spread: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Information, score and log-likelihood at ``beta``, for standardised predictors, in one aggregate."""
    k = len(names) + 1
    x = [F.lit(1.0), *[(F.col(c) - F.lit(float(m))) / F.lit(float(d)) for c, m, d in zip(names, centre, spread)]]
    shaped = cells.select("_n", "_ones", *[v.alias(f"_x{i}") for i, v in enumerate(x)])
    eta = sum((F.lit(float(b)) * F.col(f"_x{i}") for i, b in enumerate(beta)), F.lit(0.0))
    # log p = log(1 / (1 + exp(-eta))) without overflow; log (1 - p) = log p - eta
    fall = -F.log1p(F.exp(-F.abs(F.col("_e")))) - F.greatest(F.lit(0.0), -F.col("_e"))
    each = shaped.withColumn("_e", eta).withColumn("_p", 1 / (1 + F.exp(-F.col("_e")))).withColumn("_w", F.col("_n") * F.col("_p") * (1 - F.col("_p")))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = each.agg(
        *[F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i, j in pairs],
        *[F.sum((F.col("_ones") - F.col("_n") * F.col("_p")) * F.col(f"_x{i}")).alias(f"g{i}") for i in range(k)],
        F.sum(F.col("_ones") * fall + (F.col("_n") - F.col("_ones")) * (fall - F.col("_e"))).alias("l"),
    ).first()
    hess = np.zeros((k, k))
    for i, j in pairs:
        hess[i, j] = hess[j, i] = r[f"h{i}_{j}"]
    return hess, np.array([r[f"g{i}"] for i in range(k)]), r["l"]


def logistic_regression(df: DataFrame, target: str, predictors: Sequence[str], alpha: float = 0.05, max_iterations: int = 50, tol: float = 1e-9) -> Result:
    """Maximum likelihood on a target of two values (the higher counts as 1), by Newton steps.

    A step is one weighted Gram. Where predictors repeat, rows with equal ones
    are first counted into one (their counts are all that the likelihood
    needs); an approximate number of distinct rows only decides whether that
    saves work. Separable data have no maximum and raise an error.
    """
    require(df, target)
    require_numeric(df, *predictors)
    names = list(dict.fromkeys(predictors))
    rows = df.select(label(df, target).alias("_y"), *[number(c).alias(c) for c in names]).dropna()
    found = [r["_y"] for r in rows.select("_y").distinct().sort("_y").limit(3).collect()]
    if len(found) != 2:
        raise ValueError("target must have exactly two values")
    ones = (F.col("_y") == F.lit(found[1])).cast("double")
    s = rows.agg(F.count("*").alias("n"), F.sum(ones).alias("ones"), F.approx_count_distinct(F.xxhash64(*names)).alias("distinct"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(names)]).first()
    cells = rows.groupBy(*names).agg(F.count("*").cast("double").alias("_n"), F.sum(ones).alias("_ones")) if s["distinct"] * 4 < s["n"] else rows.select(*names, F.lit(1.0).alias("_n"), ones.alias("_ones"))
    cells = written(cells, "cells")
    k, n = len(names) + 1, s["n"]
    centre, spread = np.array([s[f"m{i}"] for i in range(k - 1)]), np.array([s[f"d{i}"] or 1.0 for i in range(k - 1)])
    beta, kept, best = np.zeros(k), np.zeros(k), -math.inf
    for _ in range(max_iterations):
        hess, grad, llf = _logistic_step(cells, names, centre, spread, beta)
        if llf < best - 1e-9 * abs(best):
            beta = (beta + kept) / 2  # too far: half the way
            continue
        inverse = np.linalg.pinv(hess, rcond=1e-13, hermitian=True)
        move = inverse @ grad
        kept, best, beta = beta, llf, beta + move
        if np.abs(move).max() <= tol:
            break
    else:
        raise ValueError("the likelihood has no maximum: some combination of predictors tells the two values apart")
    back = np.eye(k)
    back[0, 1:], back[np.arange(1, k), np.arange(1, k)] = -centre / spread, 1 / spread
    coef, errors = back @ beta, np.sqrt(np.maximum(np.diag(back @ inverse @ back.T), 0))
    null = s["ones"] * math.log(s["ones"] / n) + (n - s["ones"]) * math.log1p(-s["ones"] / n)
    lr = 2 * (llf - null)
    inflation = float(max(uncentred_vif(gram(rows.select(*names), names), names)))
    spark = df.sparkSession
    ps = [2 * dist.norm_sf(abs(c / e)) if e > 0 else None for c, e in zip(coef, errors)]
    table = spark.createDataFrame([(t, round(float(c), 4) + 0.0, round(math.exp(min(c, 700)), 4), None if p is None else round(p, 4), round(float(e), 4)) for t, c, e, p in zip(["const", *names], coef, errors, ps)], "term string, coef double, odds_ratio double, p_value double, std_err double")
    p = dist.chi2_sf(lr, k - 1)
    row = (float(lr), float(k - 1), p, 1 - llf / null, int(n), inflation, inflation <= VIF_LIMIT, n >= 10 * (k - 1), inflation <= VIF_LIMIT, p < alpha)
    summary = spark.createDataFrame([row], "lr_chi2 double, df double, p_value double, mcfadden double, n long, max_vif double, vif_ok boolean, size_ok boolean, assumptions_met boolean, significant boolean")
    return Result(table, summary, None)
