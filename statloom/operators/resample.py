"""Jackknife in closed form and bootstrap without moving rows; neither has a row cap."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions import dist
from statloom.functions.columns import complete, require
from statloom.functions.gram import gram, ols, uncentred_vif
from statloom.functions.ordering import placed
from statloom.operators.checks import durbin_watson
from statloom.operators.regression import VIF_LIMIT, design, predicted

STATISTICS = ("mean", "median", "std", "var")
Z95 = 1.96


def _order_statistics(ordered: DataFrame, ranks: Sequence[int]) -> dict[int, float]:
    """Values at 1-based ranks: places of the values in order meet the wanted ones by equality.

    There are at most two ranks a replicate, and at most 20,000 replicates, so
    that the wanted ones are small enough to send along.
    """
    wanted = sorted(set(int(r) for r in ranks))
    at = ordered.sparkSession.createDataFrame([(r - 1, r) for r in wanted], "place long, rank long")
    return {r["rank"]: r["x"] for r in ordered.join(F.broadcast(at), "place").select("rank", "x").collect()}


def _base(df: DataFrame, column: str, statistic: str, *keys: str):
    if statistic not in STATISTICS:
        raise ValueError(f"statistic must be one of {', '.join(STATISTICS)}")
    values = complete(df, keys, x=column)
    s = values.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")).first()
    if s["n"] < 2:
        raise ValueError("needs at least two values")
    return values, s["n"], s["mean"], s["var"]


def jackknife(df: DataFrame, column: str, statistic: str = "mean") -> DataFrame:
    """Leave-one-out bias, error and interval; deviations are population ones.

    Replicates of mean, variance and deviation are functions of a row's value
    and three totals, so one more aggregate sums them up. The median has three
    replicates at most, from the middle order statistics.
    """
    values, n, mean, var = _base(df, column, statistic)
    if statistic == "median":
        m = n // 2
        x = _order_statistics(placed(values, ["x"]), range(max(1, m), min(n, m + 2) + 1))
        if n % 2 == 0:
            reps = [(x[m + 1], m), (x[m], m)]
            theta = (x[m] + x[m + 1]) / 2
        else:
            low, mid, high = x[m], x[m + 1], x[m + 2]
            reps, theta = [((mid + high) / 2, m), ((low + high) / 2, 1), ((low + mid) / 2, m)], mid
        avg = sum(v * c for v, c in reps) / n
        spread = sum((v - avg) ** 2 * c for v, c in reps)
        lo, hi = min(v for v, _ in reps), max(v for v, _ in reps)
    else:
        d = F.col("x") - F.lit(mean)
        loo_var = F.greatest(F.lit(0.0), (F.lit(var * n) - d * d * (n / (n - 1))) / (n - 1))
        rep = {"mean": F.lit(mean) - d / (n - 1), "var": loo_var, "std": F.sqrt(loo_var)}[statistic]
        theta = {"mean": mean, "var": var, "std": math.sqrt(var)}[statistic]
        r = values.select((rep - F.lit(theta)).alias("r")).agg(F.avg("r").alias("a"), F.var_pop("r").alias("v"), F.min("r").alias("lo"), F.max("r").alias("hi")).first()
        avg, spread, lo, hi = theta + r["a"], r["v"] * n, theta + r["lo"], theta + r["hi"]
    bias, se = (n - 1) * (avg - theta), math.sqrt((n - 1) / n * spread)
    row = (statistic, n, float(theta), float(bias), float(theta - bias), se, theta - Z95 * se, theta + Z95 * se, float(lo), float(hi), n >= 10, statistic != "median")
    return df.sparkSession.createDataFrame([row], "statistic string, n long, estimate double, bias double, corrected double, std_err double, ci_low double, ci_high double, replicate_min double, replicate_max double, size_ok boolean, assumptions_met boolean")


def jackknife_regression(df: DataFrame, target: str, predictors: Sequence[str], order_by: str | None = None) -> DataFrame:
    """Leave-one-out coefficients: b - (X'X)^-1 x e / (1 - h) for each row, summed about b in one more aggregate."""
    rows, names = design(df, target, predictors, *([order_by] if order_by else []))
    g = gram(rows, [target, *names])
    fit, n, k = ols(g, target, names), g.n, len(names) + 1
    if n < k + 1:
        raise ValueError("too few rows for so many predictors")
    x = [F.lit(1.0), *[F.col(c) for c in names]]
    inv = fit.inverse
    dot = lambda i: sum((F.lit(float(inv[i, j])) * x[j] for j in range(1, k)), F.lit(float(inv[i, 0])))
    solved = rows.select(*rows.columns, *[dot(i).alias(f"_d{i}") for i in range(k)], (F.col(target) - predicted(fit)).alias("_e"))
    h = sum((F.col(f"_d{j}") * x[j] for j in range(1, k)), F.col("_d0"))
    moved = solved.withColumn("_s", F.col("_e") / (1 - h)).select(*[(-F.col(f"_d{i}") * F.col("_s")).alias(f"_m{i}") for i in range(k)])
    r = moved.agg(*[F.avg(f"_m{i}").alias(f"a{i}") for i in range(k)], *[F.stddev_samp(f"_m{i}").alias(f"s{i}") for i in range(k)]).first()
    inflation = float(max(uncentred_vif(g, names)))
    dw = durbin_watson(rows.withColumn("_res", F.col(target) - predicted(fit)), "_res", order_by).first()["statistic"] if order_by else None
    met = inflation <= VIF_LIMIT and n >= 10 * len(names) and (dw is None or 1.5 <= dw <= 2.5)
    out = []
    for i, term in enumerate(fit.terms):
        b, se = float(fit.coef[i]), r[f"s{i}"] * math.sqrt((n - 1) ** 2 / n)
        bias = (n - 1) * r[f"a{i}"]
        z = b / se if se > 0 else math.inf
        out.append((term, b, bias, b - bias, se, z, min(1.0, 2 * dist.norm_sf(abs(z))), b - Z95 * se, b + Z95 * se, n, fit.r_squared, inflation, dw, bool(met)))
    return df.sparkSession.createDataFrame(out, "term string, coef double, bias double, corrected double, std_err double, t double, p_value double, ci_low double, ci_high double, n long, r_squared double, max_vif double, durbin_watson double, assumptions_met boolean")


#: The step and the multipliers of SplitMix64 (Steele, Lea and Flood, 2014).
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1


def _mixed(z: np.ndarray) -> np.ndarray:
    """The output function of SplitMix64, in place."""
    z ^= z >> np.uint64(30)
    z *= np.uint64(MIX_A)
    z ^= z >> np.uint64(27)
    z *= np.uint64(MIX_B)
    z ^= z >> np.uint64(31)
    return z


def poisson_steps() -> list[int]:
    """Of 2**16 equal shares, those up to which a Poisson(1) count is 0, 1, 2 and so on: its inverse distribution function."""
    at, share, out = 0.0, math.exp(-1), []
    for k in range(1, 12):
        at += share
        out.append(round(at * (1 << 16)))
        share /= k
    return out


def _weights(places: np.ndarray, groups: np.ndarray, seed: int, table: np.ndarray) -> np.ndarray:
    """Counts of the rows at ``places`` in the replicates of ``groups`` of four: a stream of its own for each row, by the number of the group."""
    start = _mixed(places.astype(np.uint64) + np.uint64(seed * GOLDEN & _MASK))
    z = start[:, None] + (groups.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
    return table[_mixed(z).view(np.uint16).reshape(len(places), -1)]


def _poisson_sums(ordered: DataFrame, n_boot: int, seed: int, mean: float, sd: float) -> np.ndarray:
    """Weight, first and second power sums (of values standardised by ``mean`` and ``sd``) of every replicate.

    A row's weight in a replicate is a function of seed, place and replicate
    alone, so that neither partitions nor retries change a result.
    """
    steps = poisson_steps()

    def run(batches):
        sums = np.zeros((3, -(-n_boot // 4) * 4))
        table = np.searchsorted(steps, np.arange(1 << 16), "right").astype(float)
        groups = np.arange(sums.shape[1] // 4)
        for batch in batches:
            x = (batch.column(0).to_numpy() - mean) / sd
            places, powers = batch.column(1).to_numpy(), np.stack([np.ones(len(x)), x, x * x])
            for a in range(0, len(x), 512):
                for b in range(0, len(groups), 64):
                    sums[:, 4 * b : 4 * (b + 64)] += powers[:, a : a + 512] @ _weights(places[a : a + 512], groups[b : b + 64], seed, table)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot)), *[pa.array(s[:n_boot]) for s in sums]], ["b", "w", "s1", "s2"])

    # n_boot draws a row are far more work than moving it
    rows = ordered.select("x", "place").repartition(ordered.sparkSession.sparkContext.defaultParallelism, "place")
    per = rows.mapInArrow(run, "b long, w double, s1 double, s2 double").groupBy("b").agg(*[F.sum(c).alias(c) for c in ("w", "s1", "s2")])
    t = per.orderBy("b").toArrow()
    return np.stack([t[c].to_numpy() for c in ("w", "s1", "s2")])


def bootstrap(df: DataFrame, column: str, statistic: str = "mean", n_boot: int = 1000, random_state: int | None = None, key: str | None = None) -> DataFrame:
    """Replicates with replacement, their bias, error and percentile interval.

    Rows get Poisson weights and only sums by replicate meet (a replicate that
    by chance draws nothing of a tiny sample is left out); replicates of the
    median are order statistics at ranks drawn from their exact distribution.
    A weight is a function of ``random_state``, replicate and the row's
    ``key``, a column of unique whole numbers; without one, of the place of the
    row's value among all values in order. Results thus depend on the rows
    alone, not on partitions.
    """
    if not 1 <= n_boot <= 20_000:
        raise ValueError("n_boot must be between 1 and 20000")
    if key is not None:
        require(df, key)
        if not isinstance(df.schema[key].dataType, T.IntegralType):
            raise ValueError(f"{key} must be a column of whole numbers")
    values, n, mean, var = _base(df if key is None else df.withColumn("_key", F.col(key).cast("long")), column, statistic, *(["_key"] if key else []))
    seed = random_state if random_state is not None else int(np.random.SeedSequence().entropy % 2**32)
    ordered = values.withColumnRenamed("_key", "place") if key and statistic != "median" else placed(values.select("x"), ["x"])
    if statistic == "median":
        rng = np.random.default_rng(seed)
        m = (n + 1) // 2 if n % 2 else n // 2
        low = rng.beta(m, n - m + 1, n_boot)
        ranks = [np.clip(np.ceil(n * low), 1, n).astype(int)]
        if n % 2 == 0:
            ranks.append(np.clip(np.ceil(n * (low + (1 - low) * rng.beta(1, n - m, n_boot))), 1, n).astype(int))
        middle = (n // 2 + 1,) if n % 2 else (n // 2, n // 2 + 1)
        at = _order_statistics(ordered, np.concatenate([*ranks, middle]))
        reps = np.mean([[at[int(r)] for r in rs] for rs in ranks], axis=0)
        theta = sum(at[r] for r in middle) / len(middle)
    else:
        sd = math.sqrt(var) or 1.0
        w, s1, s2 = _poisson_sums(ordered, n_boot, seed, mean, sd)
        w, s1, s2 = (v[w > 0] for v in (w, s1, s2))
        variance = np.maximum(s2 / w - (s1 / w) ** 2, 0) * sd * sd
        reps = {"mean": mean + sd * s1 / w, "var": variance, "std": np.sqrt(variance)}[statistic]
        theta = {"mean": mean, "var": var, "std": math.sqrt(var)}[statistic]
    bias = float(reps.mean() - theta)
    low, high = np.percentile(reps, [2.5, 97.5])
    row = (statistic, n, n_boot, float(theta), bias, float(theta - bias), float(reps.std(ddof=1)) if n_boot > 1 else None, float(low), float(high), float(reps.min()), float(reps.max()), n >= 10)
    return df.sparkSession.createDataFrame([row], "statistic string, n long, n_boot int, estimate double, bias double, corrected double, std_err double, ci_low double, ci_high double, replicate_min double, replicate_max double, size_ok boolean")
