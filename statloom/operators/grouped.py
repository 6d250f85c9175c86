"""Regressions and group tests by key: one for each value of the key columns, all in the same few jobs.

Rows give the cross-products of their key in one aggregate with partial sums;
solves run in Arrow batches of many keys, and what a second pass needs is
joined back by key. The number of keys has no bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist, tails
from statloom.functions.columns import complete, label, number, require, require_numeric
from statloom.functions.ordering import midranks
from statloom.functions.scratch import written

VIF_LIMIT = 5.0


def _rows(df: DataFrame, by: Sequence[str], target: str, predictors: Sequence[str], *more: str) -> tuple[DataFrame, list[str]]:
    """Complete rows: keys, the target as ``_y``, predictors as ``_x0, _x1, ...`` and further columns as ``_m0, ...``."""
    predictors = list(dict.fromkeys(predictors))
    if not predictors or not by:
        raise ValueError("needs at least one predictor and one key")
    require(df, *by)
    require_numeric(df, target, *predictors, *more)
    cells = [number(target).alias("_y"), *[number(c).alias(f"_x{i}") for i, c in enumerate(predictors)], *[number(c).alias(f"_m{i}") for i, c in enumerate(more)]]
    out = df.select(*by, *cells)
    return out.dropna(subset=[c for c in out.columns if c not in by]), predictors


def grams(rows: DataFrame, by: Sequence[str], names: Sequence[str], weight: Column | None = None) -> DataFrame:
    """``by, n, w, sums, products``: weighted sums and upper-triangle cross-products of each key, about a value of the key's own.

    ``origin`` is that value: some row's, so that large offsets don't cancel.
    """
    w = F.lit(1.0) if weight is None else weight
    first = rows.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(*[F.any_value(c).alias(f"_o{i}") for i, c in enumerate(names)])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    shifted = rows.join(first, same).select(*by, w.alias("_w"), *[(F.col(c) - F.col(f"_o{i}")).alias(f"_d{i}") for i, c in enumerate(names)], *[f"_o{i}" for i in range(len(names))])
    k = range(len(names))
    sums = [F.sum(F.col("_w") * F.col(f"_d{i}")).alias(f"_s{i}") for i in k]
    products = [F.sum(F.col("_w") * F.col(f"_d{i}") * F.col(f"_d{j}")).alias(f"_p{i}_{j}") for i in k for j in k if j >= i]
    out = shifted.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_w").alias("w"), F.sum(F.log("_w")).alias("log_w"), *[F.first(f"_o{i}").alias(f"_o{i}") for i in k], *sums, *products)
    return out.select(*by, "n", "w", "log_w", F.array(*[f"_o{i}" for i in k]).alias("origin"), F.array(*[f"_s{i}" for i in k]).alias("sums"), F.array(*[f"_p{i}_{j}" for i in k for j in k if j >= i]).alias("products"))


def _matrices(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and centred cross-products of many keys at once."""
    w, sums, flat = pdf["w"].to_numpy(float), np.stack(pdf["sums"]), np.stack(pdf["products"])
    cross = np.zeros((len(pdf), k, k))
    upper = np.triu_indices(k)
    cross[:, upper[0], upper[1]] = flat
    cross[:, upper[1], upper[0]] = flat
    off = sums / w[:, None]
    return np.stack(pdf["origin"]) + off, cross - w[:, None, None] * off[:, :, None] * off[:, None, :]


def _solved(centred: np.ndarray, means: np.ndarray, w: np.ndarray, y: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients with the intercept first, the inverse of the cross-products, residual squares and rank, for all keys of a batch.

    Column ``y`` is the target. Predictors are scaled before the solve;
    collinear ones share by pseudo-inverse.
    """
    x = [i for i in range(centred.shape[1]) if i != y]
    sxx, sxy, syy = centred[:, x][:, :, x], centred[:, x, y], centred[:, y, y]
    sd = np.sqrt(np.where(np.diagonal(sxx, axis1=1, axis2=2) > 0, np.diagonal(sxx, axis1=1, axis2=2), 1.0))
    scaled = sxx / (sd[:, :, None] * sd[:, None, :])
    inner = np.linalg.pinv(scaled, rcond=1e-12, hermitian=True) / (sd[:, :, None] * sd[:, None, :])
    rank = np.linalg.matrix_rank(scaled, tol=1e-10, hermitian=True) + 1
    beta = np.einsum("kij,kj->ki", inner, sxy)
    ssr = np.maximum(syy - np.einsum("ki,ki->k", beta, sxy), 0)
    at = means[:, x]
    moved = np.einsum("kij,kj->ki", inner, at)
    inverse = np.empty((len(w), len(x) + 1, len(x) + 1))
    inverse[:, 0, 0] = 1 / w + np.einsum("ki,ki->k", at, moved)
    inverse[:, 0, 1:] = inverse[:, 1:, 0] = -moved
    inverse[:, 1:, 1:] = inner
    return np.concatenate([(means[:, y] - np.einsum("ki,ki->k", beta, at))[:, None], beta], 1), inverse, ssr, rank


def _linear(by: Sequence[str], predictors: Sequence[str], cells: DataFrame) -> DataFrame:
    """A row a key with arrays over the terms, the intercept first."""
    kinds = ", ".join(f"`{c}` {dict(cells.dtypes)[c]}" for c in by)
    schema = kinds + ", n long, coef array<double>, std_err array<double>, p_value array<double>, inverse array<double>, vif array<double>, r_squared double, adj_r_squared double, f double, f_p_value double, df_resid double, aic double, bic double, ssr double"

    def solve(batches):
        for pdf in batches:
            w, n = pdf["w"].to_numpy(float), pdf["n"].to_numpy(float)
            means, centred = _matrices(pdf, len(predictors) + 1)
            coef, inverse, ssr, rank = _solved(centred, means, w)
            sst, df = centred[:, 0, 0], n - rank
            with np.errstate(divide="ignore", invalid="ignore"):
                scale = np.where(df > 0, ssr / df, np.nan)
                err = np.sqrt(np.maximum(np.diagonal(inverse, axis1=1, axis2=2) * scale[:, None], 0))
                t = coef / err
                r2 = np.where(sst > 0, 1 - ssr / sst, 0.0)
                f = (sst - ssr) / (rank - 1) / scale
                llf = -n / 2 * (math.log(2 * math.pi) + np.log(np.maximum(ssr, 1e-300) / n) + 1) + pdf["log_w"].to_numpy(float) / 2
                adj = 1 - (1 - r2) * (n - 1) / df
            ps = [[dist.t_p(v, d) if d > 0 and math.isfinite(v) else None for v in row] for row, d in zip(t, df)]
            fp = [dist.f_sf(v, r - 1, d) if d > 0 and r > 1 and math.isfinite(v) else None for v, r, d in zip(f, rank, df)]
            raw = centred[:, 1:, 1:] + w[:, None, None] * means[:, 1:, None] * means[:, None, 1:]
            spread = np.sqrt(np.where(np.diagonal(raw, axis1=1, axis2=2) > 0, np.diagonal(raw, axis1=1, axis2=2), 1.0))
            unit = raw / (spread[:, :, None] * spread[:, None, :])
            whole = np.linalg.matrix_rank(unit, tol=1e-12, hermitian=True) == len(predictors)
            vif = np.where(whole[:, None], np.diagonal(np.linalg.pinv(unit, hermitian=True), axis1=1, axis2=2), np.inf)
            clean = lambda v: [x if math.isfinite(x) else None for x in map(float, v)]
            out = pdf[[*by, "n"]].copy()
            out["coef"], out["std_err"], out["p_value"] = coef.tolist(), [clean(e) for e in err], ps
            out["inverse"], out["vif"] = [m.ravel().tolist() for m in inverse], vif.tolist()
            for name, v in (("r_squared", r2), ("adj_r_squared", adj), ("f", f)):
                out[name] = clean(v)
            out["f_p_value"], out["df_resid"], out["aic"], out["bic"], out["ssr"] = fp, df, -2 * llf + 2 * rank, -2 * llf + rank * np.log(n), ssr
            yield out

    return cells.mapInPandas(solve, schema)


def _fitted(coef: str, predictors: Sequence[str]) -> Column:
    return sum((F.element_at(coef, i + 2) * F.col(f"_x{i}") for i in range(len(predictors))), F.element_at(coef, 1))


def _with_fit(rows: DataFrame, fits: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    keyed = fits.select(*[F.col(c).alias(f"_k_{c}") for c in by], *columns)
    return rows.join(keyed, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]).drop(*[f"_k_{c}" for c in by])


def _by_terms(fits: DataFrame, by: Sequence[str], terms: Sequence[str], arrays: Sequence[str], *rest: str) -> DataFrame:
    zipped = F.arrays_zip(F.array(*[F.lit(t) for t in terms]).alias("term"), *[F.col(a) for a in arrays])
    return fits.select(*by, F.explode(zipped).alias("_t"), *rest).select(*by, F.col("_t.term").alias("term"), *[F.col(f"_t.{a}").alias(a) for a in arrays], *rest)


def linear_regression_by(df: DataFrame, by: Sequence[str], target: str, predictors: Sequence[str], weights_column: str | None = None) -> DataFrame:
    """Least squares of each key: a row a term (``const`` first), with the figures of its fit and checks.

    ``breusch_pagan`` holds the squared residuals against the predictors in a
    second pass, ``max_vif`` is uncentred. Rows whose weight is not positive
    and finite are an error. Keys with too few rows have no errors.
    """
    rows, predictors = _rows(df, by, target, predictors, *([weights_column] if weights_column else []))
    weight = F.col("_m0") if weights_column else None
    if weights_column and rows.where((weight <= 0) | (F.abs(weight) == float("inf"))).limit(1).count():
        raise ValueError("weights must be finite and positive")
    names = ["_y", *[f"_x{i}" for i in range(len(predictors))]]
    fits = written(_linear(by, predictors, grams(rows, by, names, weight)), "fits")
    rest = F.col("_y") - _fitted("coef", predictors)
    squares = _with_fit(rows, fits, by, "coef").withColumn("_y", rest * rest * (weight if weights_column else F.lit(1.0)))
    spread = _linear(by, predictors, grams(squares.drop("coef"), by, names))
    lm = spread.select(*[F.col(c).alias(f"_k_{c}") for c in by], (F.col("n") * F.col("r_squared")).alias("breusch_pagan"))
    joined = fits.join(lm, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]).drop(*[f"_k_{c}" for c in by])
    figures = joined.withColumn("max_vif", F.array_max("vif")).withColumn("size_ok", F.col("n") >= 10 * len(predictors))
    return _by_terms(figures, by, ["const", *predictors], ["coef", "std_err", "p_value"], "n", "r_squared", "adj_r_squared", "f", "f_p_value", "df_resid", "aic", "bic", "max_vif", "breusch_pagan", "size_ok")


def jackknife_regression_by(df: DataFrame, by: Sequence[str], target: str, predictors: Sequence[str]) -> DataFrame:
    """Leave-one-out coefficients of each key in closed form: estimate, bias, error and normal interval of every term."""
    rows, predictors = _rows(df, by, target, predictors)
    k = len(predictors) + 1
    fits = written(_linear(by, predictors, grams(rows, by, ["_y", *[f"_x{i}" for i in range(k - 1)]])), "fits").where(F.col("n") >= k + 1)
    x = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(k - 1)]]
    each = _with_fit(rows, fits, by, "coef", "inverse", "n")
    solved = each.select(*by, "n", "coef", *[sum((F.element_at("inverse", i * k + j + 1) * x[j] for j in range(k)), F.lit(0.0)).alias(f"_d{i}") for i in range(k)], *[c for c in rows.columns if c.startswith("_x")], (F.col("_y") - _fitted("coef", predictors)).alias("_e"))
    share = F.col("_e") / (1 - sum((F.col(f"_d{j}") * x[j] for j in range(1, k)), F.col("_d0")))
    moved = solved.groupBy(*by).agg(F.first("n").alias("n"), F.first("coef").alias("coef"), F.array(*[F.avg(-F.col(f"_d{i}") * share) for i in range(k)]).alias("mean"), F.array(*[F.stddev_samp(-F.col(f"_d{i}") * share) for i in range(k)]).alias("sd"))
    out = _by_terms(moved, by, ["const", *predictors], ["coef", "mean", "sd"], "n")
    bias, se = (F.col("n") - 1) * F.col("mean"), F.col("sd") * (F.col("n") - 1) / F.sqrt("n")
    return out.select(*by, "term", "coef", bias.alias("bias"), (F.col("coef") - bias).alias("corrected"), se.alias("std_err"), (F.col("coef") - 1.96 * se).alias("ci_low"), (F.col("coef") + 1.96 * se).alias("ci_high"), "n")


def logistic_regression_by(df: DataFrame, by: Sequence[str], target: str, predictors: Sequence[str], max_iterations: int = 25, tol: float = 1e-9) -> DataFrame:
    """Maximum likelihood of each key, a row a term; the higher of a key's two target values counts as 1.

    Rows that repeat a key and its predictors are counted once and for all;
    a Newton step is then one weighted Gram of the keys that still move. Keys
    without exactly two values are left out; ``converged`` is false where
    coefficients still grow after the last step, as with separable data.
    """
    require(df, *by, target)
    predictors = list(dict.fromkeys(predictors))
    require_numeric(df, *predictors)
    rows = df.select(*by, label(df, target).alias("_v"), *[number(c).alias(f"_x{i}") for i, c in enumerate(predictors)])
    rows = rows.dropna(subset=["_v", *[f"_x{i}" for i in range(len(predictors))]])
    both = rows.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), *[F.avg(f"_x{i}").alias(f"_a{i}") for i in range(len(predictors))], *[F.coalesce(F.nullif(F.stddev_pop(f"_x{i}"), F.lit(0.0)), F.lit(1.0)).alias(f"_b{i}") for i in range(len(predictors))])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    known = rows.join(both.where("_low < _high"), same).withColumn("_one", F.when(F.col("_v") == F.col("_high"), 1.0).when(F.col("_v") == F.col("_low"), 0.0))
    scaled = [((F.col(f"_x{i}") - F.col(f"_a{i}")) / F.col(f"_b{i}")).alias(f"_x{i}") for i in range(len(predictors))]
    shape = [f"_{s}{i}" for i in range(len(predictors)) for s in "ab"]
    cells = known.select(*by, "_one", *scaled, *shape).groupBy(*by, *[f"_x{i}" for i in range(len(predictors))], *shape).agg(F.count("*").alias("_n"), F.sum("_one").alias("_ones"), F.count("_one").alias("_good"))
    cells = written(cells, "cells")
    k = len(predictors) + 1
    x = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(k - 1)]]
    kinds = ", ".join(f"`{c}` {dict(cells.dtypes)[c]}" for c in by)
    state = kinds + ", coef array<double>, raw array<double>, std_err array<double>, llf double, llnull double, n long, converged boolean, settled boolean"
    names = [*by, "coef", "raw", "std_err", "llf", "llnull", "n", "converged", "settled"]

    def step(batches):
        for pdf in batches:
            hess = np.zeros((len(pdf), k, k))
            upper = np.triu_indices(k)
            flat = np.stack(pdf["hess"])
            hess[:, upper[0], upper[1]] = flat
            hess[:, upper[1], upper[0]] = flat
            inverse = np.linalg.pinv(hess, rcond=1e-13, hermitian=True)
            beta, move = np.stack(pdf["coef"]), np.einsum("kij,kj->ki", inverse, np.stack(pdf["grad"]))
            size = np.abs(move).max(1)
            move *= np.minimum(1.0, 4.0 / np.maximum(size, 1e-300))[:, None]
            centre, spread = np.stack(pdf["centre"]), np.stack(pdf["spread"])
            new = beta + move
            # back to the predictors' own units
            back = np.zeros((len(pdf), k, k))
            back[:, 0, 0] = 1
            back[:, 0, 1:] = -centre / spread
            back[:, np.arange(1, k), np.arange(1, k)] = 1 / spread
            cover = back @ inverse @ back.transpose(0, 2, 1)
            n, ones = pdf["n"].to_numpy(float), pdf["ones"].to_numpy(float)
            null = ones * np.log(ones / n) + (n - ones) * np.log1p(-ones / n)
            out = pdf[list(by)].copy()
            out["coef"], out["raw"] = new.tolist(), np.einsum("kij,kj->ki", back, new).tolist()
            out["std_err"] = np.sqrt(np.maximum(np.diagonal(cover, axis1=1, axis2=2), 0)).tolist()
            out["llf"], out["llnull"], out["n"] = pdf["llf"], null, pdf["n"]
            out["converged"] = out["settled"] = size <= tol
            yield out[names]

    shapes = cells.groupBy(*by).agg(F.array(*[F.first(f"_a{i}") for i in range(k - 1)]).alias("centre"), F.array(*[F.first(f"_b{i}") for i in range(k - 1)]).alias("spread"), F.sum("_n").alias("n"), F.sum("_ones").alias("ones"), (F.sum("_n") == F.sum("_good")).alias("two"))
    shapes = written(shapes.where("two").drop("two"), "shapes")
    moving = shapes.select(*by, F.array(*[F.lit(0.0)] * k).alias("coef"))
    finished = []
    for last in range(max_iterations - 1, -1, -1):
        each = _with_fit(cells, moving, by, "coef")
        eta = sum((F.element_at("coef", i + 1) * x[i] for i in range(k)), F.lit(0.0))
        each = each.withColumn("_p", 1 / (1 + F.exp(-eta))).withColumn("_e", eta)
        w = F.col("_n") * F.col("_p") * (1 - F.col("_p"))
        # log p and log (1 - p) without cancellation
        fall = -F.log1p(F.exp(-F.abs(F.col("_e")))) - F.greatest(F.lit(0.0), -F.col("_e"))
        like = F.col("_ones") * fall + (F.col("_n") - F.col("_ones")) * (fall - F.col("_e"))
        sums = each.groupBy(*by).agg(F.first("coef").alias("coef"), F.array(*[F.sum(w * x[i] * x[j]) for i in range(k) for j in range(i, k)]).alias("hess"), F.array(*[F.sum((F.col("_ones") - F.col("_n") * F.col("_p")) * x[i]) for i in range(k)]).alias("grad"), F.sum(like).alias("llf"))
        moved = written(_with_fit(sums, shapes, by, "centre", "spread", "n", "ones").mapInPandas(step, state), "step")
        finished.append(moved.where("settled") if last else moved)
        moving = moved.where("NOT settled").select(*by, "coef")
        if not last or not moving.limit(1).count():
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    lr = 2 * (F.col("llf") - F.col("llnull"))
    figures = out.drop("coef").withColumnRenamed("raw", "coef").withColumns({"lr_chi2": lr, "mcfadden": 1 - F.try_divide(F.col("llf"), F.col("llnull"))})
    terms = _by_terms(figures, by, ["const", *predictors], ["coef", "std_err"], "n", "llf", "lr_chi2", "mcfadden", "converged")
    z = F.try_divide(F.col("coef"), F.col("std_err"))
    return terms.withColumn("odds_ratio", F.exp("coef")).withColumn("p_value", dist.column(lambda v: 2 * dist.norm_sf(abs(v)), z))


def one_way_anova_by(df: DataFrame, by: Sequence[str], group_col: str, value_col: str) -> DataFrame:
    """F test of equal group means within each key: ``f, df1, df2, p_value, eta_squared, n_groups, n``."""
    values = complete(df, by, labels={"_g": group_col}, _x=value_col)
    groups = values.groupBy(*by, "_g").agg(F.count("_x").cast("double").alias("_n"), F.avg("_x").alias("_mean"), F.var_pop("_x").alias("_var"))
    groups = written(groups, "groups")
    grand = groups.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg((F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("_grand"))
    gap = F.col("_mean") - F.col("_grand")
    sums = groups.join(grand, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]).groupBy(*by).agg(F.count("*").alias("n_groups"), F.sum("_n").alias("_total"), F.sum(F.col("_n") * F.col("_var")).alias("_within"), F.sum(F.col("_n") * gap * gap).alias("_between"))
    df1, df2 = (F.col("n_groups") - 1).cast("double"), F.col("_total") - F.col("n_groups")
    f = F.try_divide(F.try_divide(F.col("_between"), df1), F.try_divide(F.col("_within"), df2))
    out = sums.select(*by, f.alias("f"), df1.alias("df1"), df2.alias("df2"), F.coalesce(F.try_divide(F.col("_between"), F.col("_between") + F.col("_within")), F.lit(0.0)).alias("eta_squared"), "n_groups", F.col("_total").cast("long").alias("n"))
    return out.withColumn("p_value", tails.f_sf(F.col("f"), F.col("df1"), F.col("df2")))


def kruskal_wallis_test_by(df: DataFrame, by: Sequence[str], group_col: str, value_col: str) -> DataFrame:
    """H with tie correction over the groups within each key; ranks are running counts within the key."""
    counts = written(complete(df, by, labels={"_g": group_col}, _x=value_col).groupBy(*by, "_x", "_g").agg(F.count("*").alias("_c")), "counts")
    distinct = counts.groupBy(*by, "_x").agg(F.sum("_c").alias("_tied"))
    ranks = midranks(distinct, "_x", "_tied", by).select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_x").alias("_at"), F.col("_tied").cast("double").alias("_t"), "midrank")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    per = counts.join(ranks, [*same, F.col("_x") == F.col("_at")]).groupBy(*by, "_g").agg(F.sum(F.col("midrank") * F.col("_c")).alias("_r"), F.sum("_c").cast("double").alias("_m"))
    sums = per.groupBy(*by).agg(F.sum(F.col("_r") * F.col("_r") / F.col("_m")).alias("_s"), F.sum("_m").alias("_total"), F.count("*").alias("n_groups"))
    ties = ranks.groupBy(*[f"_k_{c}" for c in by]).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"))
    n = F.col("_total")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1), 1 - F.col("_ties") / (n * n * n - n))
    out = sums.join(ties, same).select(*by, h.alias("h"), (F.col("n_groups") - 1).cast("double").alias("df"), n.cast("long").alias("n"), "n_groups")
    return out.withColumn("p_value", F.when(F.col("df") > 0, tails.chi2_sf(F.col("h"), F.col("df"))))
