"""ARIMA by exact maximum likelihood for series of any length, and forecasts from the fitted models.

A series lies in blocks of consecutive places. For given coefficients a block
turns its values into innovations as if it began at rest, and keeps how they
would answer to other innovations before it; both are linear, so that a pass of
small matrices over the blocks of a series gives its sums of squares exactly,
the unknown values before its first one included. Starting values come from two
regressions on autocovariances (Hannan and Rissanen, 1982), the rest is Newton's
method; each step is one pass over the blocks for all series at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.functions.ordering import blocks
from statloom.functions.scratch import written
from statloom.operators.stationarity import BLOCK, ordered_series

ROUNDS, TOLERANCE = 40, 1e-6


def _long_order(n: int, p: int, q: int) -> int:
    """Order of the long autoregression of the first stage."""
    return max(p + q, min(30, int(5 * math.log10(max(n, 10))), n // 6))


def _reach(order: Sequence[int]) -> int:
    p, d, q = order
    return d + 2 * max(30, p + q) + max(p, q)


def _stationary(ar: np.ndarray) -> bool:
    """Roots of 1 - a1 z - a2 z^2 ... outside the unit circle."""
    return not len(ar) or bool(np.all(np.abs(np.roots(np.concatenate([-ar[::-1], [1]]))) > 1.0001))


def split_coefficients(x: np.ndarray, order: Sequence[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean (only without differences), autoregressive and moving-average coefficients."""
    p, d, _ = order
    const = int(d == 0)
    return (float(x[0]) if const else 0.0), x[const : const + p], x[const + p :]


def admissible(x: np.ndarray, order: Sequence[int]) -> bool:
    _, ar, ma = split_coefficients(x, order)
    return bool(np.isfinite(x).all()) and _stationary(ar) and _stationary(-ma)


# sums of a block


def differences(values: np.ndarray, order: Sequence[int], centre: float) -> np.ndarray:
    """Without differences, deviations from the mean of the series."""
    return np.diff(values, order[1]) if order[1] else values - centre


def lag_sums(values: np.ndarray, first: int, block: int, order: Sequence[int], centre: float, size: int = BLOCK) -> list[float]:
    """Count, sum and lagged products of the differences that a block owns; those before the series count as none."""
    d, reach = order[1], _reach(order) - order[1]
    w = differences(values, order, centre)
    begin = max(block * size - first - d, 0)
    out = [float(len(w) - begin), float(w[begin:].sum())]
    for k in range(reach + 1):
        at = np.arange(max(begin, k), len(w))
        out.append(float(w[at] @ w[at - k]))
    return out


@lru_cache(64)
def _response(ma: tuple[float, ...], n: int) -> np.ndarray:
    """What one innovation leaves in the following ones once the moving average is undone."""
    h = [1.0]
    for t in range(1, n):
        h.append(-sum(m * h[t - 1 - j] for j, m in enumerate(ma[:t])))
        if abs(h[-1]) > 1e100:
            return np.full(n, math.nan)
    return np.array(h)


def _filtered(u: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = len(h)
    if len(u) <= 16:
        return np.convolve(u, h)[:n]
    size = 1 << (2 * n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(u, size) * np.fft.rfft(h, size), size)[:n]


def block_products(values: np.ndarray, first: int, block: int, order: Sequence[int], centre: float, scale: float, x: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Cross-products and last innovations of a block: of its own course and of what comes from before it.

    Columns: the course from rest, then the answer to each earlier innovation;
    in the first block, to each value and innovation before the series.
    """
    p, d, q = order
    mean, ar, ma = split_coefficients(x, order)
    w = differences(values, order, centre) / scale - mean
    begin = max(block * size - first - d, 0)
    u = w[begin:].copy()
    for i, a in enumerate(ar, 1):
        at = np.arange(max(begin, i), len(w))
        u[at - begin] -= a * w[at - i]
    n = len(u)
    h = _response(tuple(ma), n) if q else np.zeros(0)
    answer = (lambda v: _filtered(np.asarray(v, float), h)) if q else (lambda v: np.concatenate([v, np.zeros(max(0, n - len(v)))])[:n])
    columns = [answer(u)]
    if block == 0:
        columns += [answer(-ar[i:]) for i in range(p)]
    columns += [answer(-ma[j:]) for j in range(q)]
    c = np.stack(columns)
    ends = c[:, ::-1][:, :q].T if n >= q else np.zeros((q, len(c)))
    return c @ c.T, ends


# of a series


def _covariance(ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Of the values and innovations before a series, for innovations of variance one."""
    p, q = len(ar), len(ma)
    top = max(p, q) + 1
    theta = np.concatenate([[1.0], ma, np.zeros(top)])
    psi = np.zeros(top)
    for k in range(top):
        psi[k] = theta[k] + sum(ar[i] * psi[k - 1 - i] for i in range(min(p, k)))
    system = np.eye(p + 1)
    for k in range(p + 1):
        for i in range(1, p + 1):
            system[k, abs(k - i)] -= ar[i - 1]
    gamma = np.linalg.solve(system, [sum(theta[j] * psi[j - k] for j in range(k, q + 1)) for k in range(p + 1)])
    v = np.eye(p + q)
    for a in range(p):
        for b in range(p):
            v[a, b] = gamma[abs(a - b)]
        for b in range(a, q):
            v[a, p + b] = v[p + b, a] = psi[b - a]
    return v


def likelihood(products: list[tuple[np.ndarray, np.ndarray]], n: int, order: Sequence[int], x: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Log-likelihood, innovation variance and last innovations from the blocks of a series in order."""
    p, d, q = order
    _, ar, ma = split_coefficients(x, order)
    total, state = products[0]
    total = total.copy()
    for gram, ends in products[1:]:
        carry = np.zeros((1 + p + q, 1 + q))
        carry[0, 0] = 1
        carry[:, 1:] = state.T
        total += carry @ gram @ carry.T
        state = ends[:, 1:] @ state
        state[:, 0] += ends[:, 0]
    v = _covariance(ar, ma)
    inner = np.eye(p + q) + v @ total[1:, 1:]
    before = -np.linalg.solve(inner, v @ total[1:, 0])
    squares = total[0, 0] + before @ total[1:, 0]
    sign, logs = np.linalg.slogdet(inner)
    m = n - d
    if not (squares > 0 and sign > 0 and np.isfinite(logs)):
        return -math.inf, math.nan, np.full(q, math.nan)
    s2 = squares / m
    return -0.5 * (m * math.log(2 * math.pi * s2) + logs + m), s2, state[:, 0] + state[:, 1:] @ before


def starting_values(sums: np.ndarray, n: int, order: Sequence[int]) -> tuple[float, np.ndarray]:
    """Scale and coefficients from count, sum and lagged products of a series.

    A long autoregression gives stand-ins for the innovations; values are then
    regressed on values and stand-ins before them. Both only need autocovariances.
    """
    p, d, q = order
    c = sums[2:] / sums[0]
    scale = math.sqrt(max(c[0] - (sums[1] / sums[0]) ** 2, 0.0)) or 1.0
    c = c / c[0] if c[0] > 0 else np.eye(1, len(c))[0]
    k = _long_order(n, p, q)
    toeplitz = c[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
    long = np.concatenate([[1.0], -np.linalg.lstsq(toeplitz + 1e-9 * np.eye(k), c[1 : k + 1], rcond=None)[0]])
    at = lambda lag: c[abs(lag)]
    value_shock = lambda i, j: sum(a * at(j + t - i) for t, a in enumerate(long))
    shocks = lambda i, j: sum(a * value_shock(i + t, j) for t, a in enumerate(long))
    g, r = np.zeros((p + q, p + q)), np.zeros(p + q)
    for i in range(p):
        r[i] = at(i + 1)
        for j in range(p):
            g[i, j] = at(i - j)
        for j in range(q):
            g[i, p + j] = g[p + j, i] = value_shock(i + 1, j + 1)
    for i in range(q):
        r[p + i] = value_shock(0, i + 1)
        for j in range(q):
            g[p + i, p + j] = shocks(i + 1, j + 1)
    beta = np.linalg.lstsq(g + 1e-9 * np.eye(p + q), r, rcond=None)[0] if p + q else r
    x = np.concatenate([[0.0] if d == 0 else [], beta])
    first = int(d == 0)
    for _ in range(200):
        if admissible(x, order):
            break
        x[first:] *= 0.9
    return scale, x


def _step_length(x: np.ndarray, n: int, order: Sequence[int]) -> float:
    """Small against the errors of the coefficients, and such that the neighbours stay in the admissible region."""
    h = min(1e-3, 0.05 / math.sqrt(n))
    for _ in range(12):
        if all(admissible(v, order) for v in _neighbours(x, h)):
            break
        h /= 2
    return h


def _neighbours(x: np.ndarray, h: float) -> list[np.ndarray]:
    k, e = len(x), np.eye(len(x)) * h
    return [x + s * e[i] for i in range(k) for s in (1, -1)] + [x + e[i] + e[j] for i in range(k) for j in range(i)]


def stencil(x: np.ndarray, n: int, order: Sequence[int]) -> list[list[float]]:
    """The point, its neighbours on either side in each direction, and in each pair of directions."""
    return [list(map(float, v)) for v in (x, *_neighbours(x, _step_length(x, n, order)))]


def newton(x: np.ndarray, f: list[float], n: int, order: Sequence[int]) -> tuple[np.ndarray, np.ndarray, bool]:
    """The next point, errors of the coefficients at this one, and whether the step was held back by the admissible region."""
    k = len(x)
    if not k:
        return x, np.empty(0), False
    h = _step_length(x, n, order)
    grad = np.array([(f[1 + 2 * i] - f[2 + 2 * i]) / (2 * h) for i in range(k)])
    hess = np.zeros((k, k))
    pair = 1 + 2 * k
    for i in range(k):
        hess[i, i] = (f[1 + 2 * i] - 2 * f[0] + f[2 + 2 * i]) / h**2
        for j in range(i):
            hess[i, j] = hess[j, i] = (f[pair] - f[1 + 2 * i] - f[1 + 2 * j] + f[0]) / h**2
            pair += 1
    if not (np.isfinite(hess).all() and np.isfinite(grad).all()):
        return x, np.full(k, math.nan), True
    values, vectors = np.linalg.eigh(hess)
    errors = np.sqrt(np.diag(np.linalg.inv(-hess))) if values.max() < 0 else np.full(k, math.nan)
    step = vectors @ ((vectors.T @ grad) / np.maximum(np.abs(values), 1e-3 * n))
    step *= min(1.0, 0.5 / max(np.abs(step).max(), 1e-300))
    held = False
    while np.abs(step).max() > TOLERANCE * 0.1 and not admissible(x + step, order):
        step, held = step / 2, True
    return (x + step if admissible(x + step, order) else x), errors, held


def advance(state: dict, f: list[float], order: Sequence[int]) -> dict:
    """One round of the climb from the likelihoods at the stencil of ``state['x']``."""
    x, n = np.array(state["x"], float), state["n"]
    moved = np.abs(x - np.array(state["from"], float)).max(initial=0)
    if f[0] < state["f"] - 1e-10 * abs(state["f"]) and moved > 2 * TOLERANCE and state["round"] < ROUNDS - 1:
        nearer = (x + np.array(state["from"])) / 2  # too far: half the way
        return state | {"x": nearer.tolist(), "round": state["round"] + 1}
    target, errors, held = newton(x, f, n, order)
    still = not len(x) or np.abs(target - x).max() <= max(TOLERANCE, 1e-4 / math.sqrt(n)) or (held and f[0] - state["f"] < 1e-4)
    done = still or state["round"] >= ROUNDS - 1
    # where the climb ends at the edge of the region, the likelihood has no curvature to read errors from
    errors = np.full(len(x), math.nan) if held and done else errors
    return state | {"x": x.tolist() if done else target.tolist(), "from": x.tolist(), "f": float(f[0]), "errors": errors.tolist(), "done": bool(done), "round": state["round"] + 1}


MODEL = "p int, d int, q int, terms array<string>, coef array<double>, std_err array<double>, p_values array<double>, sigma2 double, llf double, aic double, bic double, n long, tail array<double>, shocks array<double>, ends array<double>"


def described(state: dict, at: tuple[float, float, list[float]], last: np.ndarray, order: Sequence[int]) -> dict:
    """A row of the model table; ``last`` has the values at the end of the series."""
    p, d, q = order
    scale, n, const = state["scale"], state["n"], order[1] == 0
    llf, s2, shocks = at
    m = n - d
    coef, errors = np.array(state["x"], float), np.array(state["errors"], float)
    if const:
        coef[0], errors[0] = state["centre"] + coef[0] * scale, errors[0] * scale
    ps = [2 * dist.norm_sf(abs(c / s)) if s > 0 else math.nan for c, s in zip(coef, errors)]
    llf, free = llf - m * math.log(scale), len(coef) + 1
    names = ["const"] * const + [f"ar.L{i + 1}" for i in range(p)] + [f"ma.L{i + 1}" for i in range(q)]
    w = np.diff(last, d) if d else last
    ends = [float((np.diff(last, i) if i else last)[-1]) for i in range(d)]
    return {"p": p, "d": d, "q": q, "terms": names, "coef": coef.tolist(), "std_err": errors.tolist(), "p_values": ps, "sigma2": float(s2 * scale**2), "llf": float(llf), "aic": float(-2 * llf + 2 * free), "bic": float(-2 * llf + free * math.log(m)), "n": n, "tail": [float(v) for v in w[len(w) - p :]], "shocks": [float(v) * scale for v in shocks[::-1]], "ends": ends}


def least_rows(order: Sequence[int]) -> int:
    p, d, q = order
    return d + max(p, q) * 3 + 8


def fit_arima_model(df: DataFrame, key: str, order_by: str, value: str, order: Sequence[int] = (1, 1, 1)) -> DataFrame:
    """The model table: one row a series, with what a forecast needs. Series too short for the order give no row.

    A constant is fitted where there are no differences. Errors come from the
    curvature of the likelihood; at the edge of the admissible region, where it
    has none, they are missing.
    """
    p, d, q = order
    rows = ordered_series(df, key, order_by, value).where(F.col("n") >= least_rows(order))
    kind = dict(rows.dtypes)["series"]
    cut = written(blocks(rows, ["series", "n", "mean"], ["y"], BLOCK, _reach(order)), "blocks")

    def sums(batches):
        for batch in batches:
            got = [lag_sums(v.values.to_numpy(), first, block, order, centre) for centre, block, first, v in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), batch.column(5))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, pa.list_(pa.float64()))], ["series", "n", "centre", "sums"])

    per_lag = cut.mapInArrow(sums, f"series {kind}, n long, centre double, sums array<double>").select("series", "n", "centre", F.posexplode("sums").alias("i", "v"))
    per_lag = per_lag.groupBy("series", "n", "centre", "i").agg(F.sum("v").alias("v"))
    end = cut.where((F.col("block") + 1) * BLOCK >= F.col("n")).select(F.col("series").alias("_s"), F.slice("y", F.greatest(F.lit(1), F.size("y") - p - d), p + d + 1).alias("last"))
    state = "series {0}, n long, centre double, scale double, x array<double>, `from` array<double>, f double, errors array<double>, done boolean, round int, points array<array<double>>, llf double, s2 double, shocks array<double>"
    names = [c.split()[0].strip("`") for c in state.format(kind).split(", ")]

    def begin(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        scale, x = starting_values(pdf.sort_values("i")["v"].to_numpy(), n, order)
        return pd.DataFrame([(group[0], n, float(pdf["centre"].iloc[0]), scale, x.tolist(), x.tolist(), -1e300, [], False, 0, stencil(x, n, order), None, None, [])], columns=names)

    states = written(per_lag.groupBy("series").applyInPandas(begin, state.format(kind)), "starts")

    def products(batches):
        for batch in batches:
            out = []
            for i, (centre, block, first, scale, points) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 6, 7)))):
                values = batch.column(5)[i].values.to_numpy()
                for at, x in enumerate(points):
                    gram, ends = block_products(values, first, block, order, centre, scale, np.array(x))
                    out.append((i, at, block, gram.ravel().tolist(), ends.ravel().tolist()))
            if out:
                row, at, block, gram, ends = zip(*out)
                lists = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(block), pa.array(gram, lists), pa.array(ends, lists)], ["series", "at", "block", "gram", "ends"])

    def climbed(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        now = pdf.iloc[0]
        points, n = [np.array(x, float) for x in now["points"]], int(now["n"])
        found = []
        for i, x in enumerate(points):
            part = pdf[pdf["at"] == i].sort_values("block")
            shaped = [(np.array(g).reshape(w := (1 + q + (p if b == 0 else 0)), w), np.array(e).reshape(q, w)) for b, g, e in zip(part["block"], part["gram"], part["ends"])]
            found.append(likelihood(shaped, n, order, x) if admissible(x, order) else (math.nan, math.nan, np.full(q, math.nan)))
        old = {"n": n, "x": points[0], "from": now["from"], "f": now["f"], "round": int(now["round"]), "errors": list(now["errors"]), "done": False}
        new = advance(old, [f[0] for f in found], order)
        llf, s2, shocks = found[0]
        return pd.DataFrame([(group[0], n, now["centre"], now["scale"], new["x"], new["from"], new["f"], new["errors"], new["done"], new["round"], stencil(np.array(new["x"], float), n, order), llf, s2, list(shocks))], columns=names)

    finished = []
    for _ in range(ROUNDS + 1):
        at = states.select(F.col("series").alias("_s"), "scale", "points")
        each = cut.join(at, F.col("series").eqNullSafe(F.col("_s"))).drop("_s").mapInArrow(products, f"series {kind}, at int, block long, gram array<double>, ends array<double>")
        keyed = each.join(states.withColumnRenamed("series", "_s"), F.col("series").eqNullSafe(F.col("_s"))).drop("_s")
        moved = written(keyed.groupBy("series").applyInPandas(climbed, state.format(kind)), "climb")
        finished.append(moved.where("done"))
        states = moved.where("NOT done")
        if not states.limit(1).count():
            break
    everything = finished[0]
    for more in finished[1:]:
        everything = everything.unionByName(more)

    def table(batches):
        for pdf in batches:
            rows = [{"series": s["series"]} | described(s, (s["llf"], s["s2"], s["shocks"]), np.array(s["last"], float), order) for s in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=["series", *(c.split()[0] for c in MODEL.split(", "))])

    return everything.join(end, F.col("series").eqNullSafe(F.col("_s"))).drop("_s").mapInPandas(table, f"series {kind}, {MODEL}")


def fit_arima(y: np.ndarray, order: tuple[int, int, int], size: int = BLOCK) -> dict:
    """The same for one short series in memory."""
    n, centre = len(y), float(y.mean())
    cut = [(b, max(0, b * size - _reach(order))) for b in range(-(-n // size))]
    parts = [(b, first, y[first : min(n, (b + 1) * size)]) for b, first in cut]
    scale, x = starting_values(np.sum([lag_sums(v, first, b, order, centre, size) for b, first, v in parts], axis=0), n, order)
    state = {"n": n, "centre": centre, "scale": scale, "x": x.tolist(), "from": x.tolist(), "f": -1e300, "round": 0, "errors": [], "done": False}
    while not state["done"]:
        points = [np.array(v) for v in stencil(np.array(state["x"], float), n, order)]
        found = [likelihood([block_products(v, first, b, order, centre, scale, at, size) for b, first, v in parts], n, order, at) if admissible(at, order) else (math.nan,) * 3 for at in points]
        state = advance(state, [f[0] for f in found], order)
    return described(state, found[0], y[-(order[0] + order[1] + 1) :], order)


def forecast_path(m: dict, steps: int, alpha: float) -> list[tuple[int, float, float, float]]:
    """Forecasts with intervals from psi weights."""
    const = m["coef"][0] if m["d"] == 0 else 0.0
    coef = np.array(m["coef"][int(m["d"] == 0) :], float)
    ar, ma = coef[: m["p"]], coef[m["p"] :]
    past, shocks = [v - const for v in m["tail"]], list(m["shocks"])
    path = []
    for h in range(steps):
        v = sum(a * past[-1 - i] for i, a in enumerate(ar)) + sum(b * shocks[-1 - j + h] for j, b in enumerate(ma) if j >= h)
        past.append(v)
        path.append(v + const)
    for end in reversed(m["ends"]):
        path = (np.cumsum(path) + end).tolist()
    full = np.array([1.0, *(-ar)])
    for _ in range(m["d"]):
        full = np.convolve(full, [1, -1])
    psi = []
    for h in range(steps):
        psi.append((1.0 if h == 0 else float(ma[h - 1]) if h <= len(ma) else 0.0) - sum(full[i] * psi[h - i] for i in range(1, min(h, len(full) - 1) + 1)))
    half = dist.norm_isf(alpha / 2) * np.sqrt(m["sigma2"] * np.cumsum(np.square(psi)))
    return [(h + 1, round(v, 4), round(v - w, 4), round(v + w, 4)) for h, (v, w) in enumerate(zip(path, half))]


def forecast_time_series(models: DataFrame, steps: int = 10, alpha: float = 0.05) -> DataFrame:
    """Forecasts of every series from the model table alone."""
    kind = dict(models.dtypes)["series"]

    def run(batches):
        for pdf in batches:
            rows = [(m["series"], *r) for m in pdf.to_dict("records") for r in forecast_path(m, steps, alpha)]
            yield pd.DataFrame(rows, columns=["series", "step", "forecast", "ci_lower", "ci_upper"])

    return models.mapInPandas(run, f"series {kind}, step int, forecast double, ci_lower double, ci_upper double")
