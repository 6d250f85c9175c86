"""Choice of predictors: one pass over the rows, then every trial model is a solve of part of one Gram matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame

from statloom.functions.gram import Fit, Gram, gram, ols
from statloom.operators.regression import Result, _finish, design

CRITERIA = ("aic", "bic", "r_squared", "p_value", "mallows_cp")
MAX_MODELS = 50_000


def _start(df: DataFrame, target: str, candidates: Sequence[str], criterion: str, max_predictors: int | None):
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {', '.join(CRITERIA)}")
    if max_predictors is not None and max_predictors < 1:
        raise ValueError("max_predictors must be 1 or more")
    rows, names = design(df, target, candidates)
    g = gram(rows, [target, *names])
    full_mse = ols(g, target, names).scale
    if criterion == "mallows_cp" and not full_mse > 0:
        raise ValueError("the full model leaves no residual variance")
    return rows, names, g, full_mse


def _score(fit: Fit, criterion: str, full_mse: float) -> float:
    """Lower is better throughout."""
    if criterion == "mallows_cp":
        return fit.ssr / full_mse - fit.n + 2 * fit.k
    return {"aic": fit.aic, "bic": fit.bic, "r_squared": -fit.adj_r_squared}[criterion]


def _told(spark, steps: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i + 1, name, float(s)) for i, (name, s) in enumerate(steps)], "step int, predictor string, score double")


def _shown(criterion: str, score: float) -> float:
    return -score if criterion == "r_squared" else score


def forward_selection(df: DataFrame, target: str, candidates: Sequence[str], criterion: str = "aic", p_value_threshold: float = 0.05, max_predictors: int | None = None, alpha: float = 0.05) -> tuple[Result, DataFrame]:
    """Adds the best predictor while it improves the criterion; ``r_squared`` is the adjusted one. Result and steps."""
    rows, names, g, mse = _start(df, target, candidates, criterion, max_predictors)
    chosen: list[str] = []
    steps: list[tuple] = []
    best = p_value_threshold if criterion == "p_value" else _score(ols(g, target, []), criterion, mse)
    while len(chosen) < min(max_predictors or len(names), len(names)):
        trials = []
        for c in names:
            if c not in chosen:
                fit = ols(g, target, [*chosen, c])
                trials.append((float(fit.p_values[-1]) if criterion == "p_value" else _score(fit, criterion, mse), len(trials), c))
        score, _, name = min(trials)
        if not score < best:
            break
        chosen.append(name)
        steps.append((name, _shown(criterion, score)))
        if criterion != "p_value":
            best = score
    if not chosen:
        raise ValueError("selection did not add any predictor")
    return _result(df, rows, g, target, chosen, alpha), _told(df.sparkSession, steps)


def backward_elimination(df: DataFrame, target: str, predictors: Sequence[str], criterion: str = "aic", p_value_threshold: float = 0.05, alpha: float = 0.05) -> tuple[Result | Fit, DataFrame]:
    """Drops the predictor whose loss is best while that improves the criterion. All gone: the intercept-only fit."""
    rows, names, g, mse = _start(df, target, predictors, criterion, None)
    left, steps = list(names), []
    best = math.inf if criterion == "p_value" else _score(ols(g, target, left), criterion, mse)
    while left:
        if criterion == "p_value":
            p = ols(g, target, left).p_values[1:]
            worst = max(range(len(left)), key=lambda i: (p[i], -i))
            score, name, go = float(p[worst]), left[worst], p[worst] > p_value_threshold
        else:
            score, _, name = min((_score(ols(g, target, [x for x in left if x != c]), criterion, mse), i, c) for i, c in enumerate(left))
            go = score < best
        if not go:
            break
        left.remove(name)
        steps.append((name, _shown(criterion, score)))
        best = score
    if not steps:
        raise ValueError("elimination did not remove any predictor")
    return (_result(df, rows, g, target, left, alpha) if left else ols(g, target, [])), _told(df.sparkSession, steps)


def best_subset_selection(df: DataFrame, target: str, candidates: Sequence[str], criterion: str = "aic", max_predictors: int = 10, alpha: float = 0.05) -> tuple[Result, list[str]]:
    """The best of all subsets of up to ``max_predictors``; by p-value the subset with the least largest p below ``alpha``."""
    rows, names, g, mse = _start(df, target, candidates, criterion, max_predictors)
    most = min(max_predictors, len(names))
    if sum(math.comb(len(names), k) for k in range(1, most + 1)) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models; lower max_predictors")
    best, chosen = math.inf, None
    for k in range(1, most + 1):
        for subset in combinations(names, k):
            fit = ols(g, target, list(subset))
            score = float(max(fit.p_values[1:])) if criterion == "p_value" else _score(fit, criterion, mse)
            if score < best and not (criterion == "p_value" and score >= alpha):
                best, chosen = score, list(subset)
    if chosen is None:
        raise ValueError("no subset was selected")
    return _result(df, rows, g, target, chosen, alpha), chosen


def _result(df: DataFrame, rows: DataFrame, g: Gram, target: str, chosen: list[str], alpha: float) -> Result:
    return _finish(df, rows, g, ols(g, target, chosen), target, chosen, None, None, alpha)
