"""Gram matrices: one pass over the rows, then every fit is a small solve on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist


@dataclass
class Gram:
    """Weighted means and centred cross-products of named columns, with raw ones for uncentred uses."""

    names: list[str]
    n: float
    weight: float
    means: np.ndarray
    centred: np.ndarray
    log_weight: float = 0.0

    @property
    def raw(self) -> np.ndarray:
        return self.centred + self.weight * np.outer(self.means, self.means)

    def pick(self, names: list[str]) -> np.ndarray:
        return np.array([self.names.index(x) for x in names], int)


def gram(rows: DataFrame, names: list[str], weight: Column | None = None) -> Gram:
    """Centred cross-products by built-in aggregates: sums about a first row's values, shifted to the means.

    Shifting by values of the data keeps large offsets from cancelling; rows
    are read once after a one-row look-up.
    """
    w = F.lit(1.0) if weight is None else weight
    first = rows.select(*names).first()
    if first is None:
        raise ValueError("no complete row")
    shifted = rows.select(*[(F.col(c) - F.lit(float(first[c]))).alias(f"_{i}") for i, c in enumerate(names)], w.alias("_w"))
    k = range(len(names))
    sums = [F.count("*").alias("n"), F.sum("_w").alias("w"), F.sum(F.log("_w")).alias("lw"), *[F.sum(F.col("_w") * F.col(f"_{i}")).alias(f"s_{i}") for i in k]]
    sums += [F.sum(F.col("_w") * F.col(f"_{i}") * F.col(f"_{j}")).alias(f"p_{i}_{j}") for i in k for j in range(i, len(names))]
    r = shifted.agg(*sums).first()
    mean = np.array([r[f"s_{i}"] / r["w"] for i in k])
    cross = np.zeros((len(names), len(names)))
    for i in k:
        for j in range(i, len(names)):
            cross[i, j] = cross[j, i] = r[f"p_{i}_{j}"] - r["w"] * mean[i] * mean[j]
    return Gram(list(names), r["n"], r["w"], mean + [float(first[c]) for c in names], cross, r["lw"])


@dataclass
class Fit:
    """A least-squares fit read off a Gram matrix; ``terms`` starts with the intercept."""

    terms: list[str]
    coef: np.ndarray
    inverse: np.ndarray
    n: float
    k: int
    ssr: float
    sst: float
    llf: float

    @property
    def df_resid(self) -> float:
        return self.n - self.k

    @property
    def scale(self) -> float:
        return self.ssr / self.df_resid if self.df_resid > 0 else math.nan

    @property
    def std_err(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.inverse) * self.scale, 0))

    @property
    def r_squared(self) -> float:
        return 1 - self.ssr / self.sst if self.sst > 0 else 0.0

    @property
    def adj_r_squared(self) -> float:
        return 1 - (1 - self.r_squared) * (self.n - 1) / self.df_resid if self.df_resid > 0 else math.nan

    @property
    def aic(self) -> float:
        return -2 * self.llf + 2 * self.k

    @property
    def bic(self) -> float:
        return -2 * self.llf + self.k * math.log(self.n)

    @property
    def p_values(self) -> np.ndarray:
        t = [c / s if s > 0 else math.inf for c, s in zip(self.coef, self.std_err)]
        return np.array([dist.t_p(x, self.df_resid) if math.isfinite(x) else 0.0 for x in t])

    @property
    def f(self) -> float:
        return (self.sst - self.ssr) / (self.k - 1) / self.scale if self.k > 1 else math.nan


def ols(g: Gram, target: str, predictors: list[str]) -> Fit:
    """Fit with an intercept; columns are standardised before solving, collinear ones share by pseudo-inverse."""
    x, y = g.pick(predictors), g.pick([target])[0]
    sxx, sxy, syy = g.centred[np.ix_(x, x)], g.centred[x, y], float(g.centred[y, y])
    sd = np.sqrt(np.where(np.diag(sxx) > 0, np.diag(sxx), 1.0))
    inner = np.linalg.pinv(sxx / np.outer(sd, sd), rcond=1e-12, hermitian=True) / np.outer(sd, sd) if len(x) else np.zeros((0, 0))
    beta = inner @ sxy
    rank = int(np.linalg.matrix_rank(sxx / np.outer(sd, sd), hermitian=True, tol=1e-10)) if len(x) else 0
    ssr = max(syy - float(beta @ sxy), 0.0)
    means = g.means[x]
    inverse = np.zeros((len(x) + 1,) * 2)
    inverse[0, 0] = 1 / g.weight + means @ inner @ means
    inverse[0, 1:] = inverse[1:, 0] = -(inner @ means)
    inverse[1:, 1:] = inner
    llf = -g.n / 2 * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / g.n) + 1) + g.log_weight / 2
    coef = np.concatenate([[g.means[y] - beta @ means], beta])
    return Fit(["const", *predictors], coef, inverse, g.n, rank + 1, ssr, syy, llf)


def uncentred_vif(g: Gram, predictors: list[str]) -> np.ndarray:
    """(Z'Z)_jj times its inverse's diagonal, without an intercept."""
    if len(predictors) == 1:
        return np.ones(1)
    z = g.raw[np.ix_(g.pick(predictors), g.pick(predictors))]
    sd = np.sqrt(np.where(np.diag(z) > 0, np.diag(z), 1.0))
    try:
        return np.diag(np.linalg.inv(z / np.outer(sd, sd)))
    except np.linalg.LinAlgError:
        return np.full(len(predictors), np.inf)
