"""SQL of regressions: cross-products, solved by sweeping one pivot after another."""

from __future__ import annotations

from collections.abc import Sequence


def swept(name: str, source: str, k: int, pivots: Sequence[int], keep: str = "") -> tuple[str, str]:
    """Steps that sweep ``pivots`` of the symmetric matrix in columns a0_0, a0_1, ... of ``source``; also the last step's name.

    A swept block holds minus its inverse, and the columns beside it the solution.
    """
    at = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    out, before = "", source
    for p in pivots:
        d = at(p, p)
        cells = []
        for i in range(k):
            for j in range(i, k):
                if i == p and j == p:
                    cells.append(f"-1 / {d} AS {d}")
                elif p in (i, j):
                    cells.append(f"{at(i, j)} / {d} AS {at(i, j)}")
                else:
                    cells.append(f"{at(i, j)} - {at(i, p)} * {at(p, j)} / {d} AS {at(i, j)}")
        out += f",\n{name}{p} AS MATERIALIZED (SELECT {keep}{', '.join(cells)} FROM {before})"
        before = f"{name}{p}"
    return out, before


def products(columns: Sequence[str], weight: str = "1") -> str:
    """Weighted sums of products of all pairs, as a0_0, a0_1, ..."""
    return ", ".join(f"sum({weight} * ({a}) * ({columns[j]}))::DOUBLE AS a{i}_{j}" for i, a in enumerate(columns) for j in range(i, len(columns)))


def logistic_sql(source: str, predictors: Sequence[str], by: Sequence[str] = (), rounds: int = 9, tail: str = "") -> str:
    """Newton steps from zero on ``source``, which gives keys, y (0 or 1) and predictors; ``t`` has a row a term."""
    k = len(predictors) + 1
    keys = "".join(f"{c}, " for c in by)
    scale = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(predictors))
    on = " AND ".join(f"r.{c} = s.{c}" for c in by) or "true"
    out = f"""
WITH r AS (SELECT * FROM ({source})),
s AS MATERIALIZED (SELECT {keys}{scale}, count(*) AS n, sum(y) AS ones FROM r {'GROUP BY ' + ', '.join(by) if by else ''}),
c AS MATERIALIZED (SELECT {''.join(f'r.{c}, ' for c in by)}{', '.join(f'(r.{c} - m{i}) / d{i} AS x{i + 1}' for i, c in enumerate(predictors))}, 1.0 AS x0, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS ones FROM r JOIN s ON {on} GROUP BY ALL),
b0 AS MATERIALIZED (SELECT {keys}{', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k))} FROM s)"""
    xs = [f"x{i}" for i in range(k)]
    join = " AND ".join(f"c.{x} = b.{x}" for x in by) or "true"
    for r in range(1, rounds + 1):
        eta = " + ".join(f"b{i} * x{i}" for i in range(k))
        last = k  # the right-hand side is the last column; its own square is not used
        cells = ", ".join([*[f"sum(n * p * (1 - p) * x{i} * x{j}) AS a{i}_{j}" for i in range(k) for j in range(i, k)], *[f"sum((ones - n * p) * x{i}) AS a{i}_{last}" for i in range(k)], f"0.0::DOUBLE AS a{last}_{last}"])
        olds = ", ".join(f"any_value(b{i}) AS b{i}" for i in range(k))
        grouped = f"GROUP BY {', '.join(by)}" if by else ""
        out += f""",
e{r} AS (SELECT {''.join(f'c.{x}, ' for x in by)}{', '.join(xs)}, n, ones, {', '.join(f'b{i}' for i in range(k))}, 1 / (1 + exp(-({eta}))) AS p FROM c JOIN b{r - 1} b ON {join}),
h{r} AS MATERIALIZED (SELECT {keys}{olds}, sum(ones * ln(p) + (n - ones) * ln(1 - p)) AS llf, {cells} FROM e{r} {grouped})"""
        steps, end = swept(f"w{r}_", f"h{r}", k + 1, range(k), keys + "llf, " + "".join(f"b{i}, " for i in range(k)))
        inverse = "".join(f", -a{i}_{j} AS v{i}_{j}" for i in range(k) for j in range(i, k))
        out += steps + f",\nb{r} AS MATERIALIZED (SELECT {keys}llf, {', '.join(f'b{i} + a{i}_{last} AS b{i}' for i in range(k))}{inverse} FROM {end})"
    using = " AND ".join(f"b.{x} = s.{x}" for x in by) or "true"
    bare = "".join(f"b.{c}, " for c in by)
    shift = " - ".join(["b0", *[f"b{i + 1} * m{i} / d{i}" for i in range(k - 1)]])
    g = ["1", *[f"(-m{i} / d{i})" for i in range(k - 1)]]
    spread = " + ".join(f"{g[i]} * {g[j]} * v{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k))
    rows = [f"SELECT {bare}'const' AS term, {shift} AS coef, sqrt({spread}) AS std_err, llf, s.n, s.ones FROM b{rounds} b JOIN s ON {using}"]
    rows += [f"SELECT {bare}'{c}', b{i + 1} / d{i}, sqrt(v{i + 1}_{i + 1}) / d{i}, llf, s.n, s.ones FROM b{rounds} b JOIN s ON {using}" for i, c in enumerate(predictors)]
    return out + f",\nt AS ({' UNION ALL '.join(rows)})\n{tail}"


def linear_by_sql(table: str, by: str, target: str, predictors: Sequence[str], tail: str) -> str:
    """Least squares of each key about the key's means; ``t`` has a row a term."""
    k = len(predictors)
    names = [*predictors, target]
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(names))
    cells = products([f"({c} - m{i})" for i, c in enumerate(names)])
    steps, end = swept("w", "g", k + 1, range(k), f"{by}, n, {', '.join(f'm{i}' for i in range(k + 1))}, ")
    inner = " + ".join(f"m{i} * m{j} * -a{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k))
    shift = " - ".join([f"m{k}", *[f"a{i}_{k} * m{i}" for i in range(k)]])
    rows = [f"SELECT {by}, n, s2, 'const' AS term, {shift} AS coef, sqrt(s2 * (1.0 / n + {inner})) AS std_err FROM f"]
    rows += [f"SELECT {by}, n, s2, '{c}', a{i}_{k}, sqrt(s2 * -a{i}_{i}) FROM f" for i, c in enumerate(predictors)]
    return f"""
WITH m AS (SELECT {by}, count(*) AS n, {means} FROM {table} GROUP BY {by}),
g AS MATERIALIZED (SELECT {by}, any_value(n) AS n, {', '.join(f'any_value(m{i}) AS m{i}' for i in range(k + 1))}, {cells} FROM {table} JOIN m USING ({by}) GROUP BY {by}){steps},
f AS (SELECT *, a{k}_{k} / (n - {k + 1}) AS s2 FROM {end}),
t AS ({' UNION ALL '.join(rows)})
{tail}"""


def irls_sql(source: str, rounds: int = 8, digits: int = 3, tol: float = 1e-3) -> str:
    """Weights from a fit of log squared residuals, round after round; a series of rounds that has settled stays as it is.

    ``source`` gives y, a and b; predictors are taken about their means.
    """
    xs = ["1", "a", "b"]
    out = f"""
WITH r AS (SELECT * FROM ({source})),
m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM r),
base AS MATERIALIZED (SELECT y, a - ma AS a, b - mb AS b FROM r, m),
g0 AS MATERIALIZED (SELECT {products([*xs, 'y'])} FROM base)"""
    steps, end = swept("o", "g0", 4, range(3))
    out += steps + f",\ns0 AS MATERIALIZED (SELECT a0_3 AS c0, a1_3 AS c1, a2_3 AS c2, false AS done, 0 AS rounds FROM {end})"
    fit = "c0 + c1 * a + c2 * b"
    for i in range(1, rounds + 1):
        out += f",\nv{i} AS MATERIALIZED (SELECT {products([*xs, f'ln((y - ({fit})) ^ 2 + 1e-8)'])} FROM base, s{i - 1})"
        steps, end = swept(f"v{i}_", f"v{i}", 4, range(3))
        out += steps + f",\nw{i} AS MATERIALIZED (SELECT {products([*xs, 'y'], 'exp(-(q.a0_3 + q.a1_3 * a + q.a2_3 * b))')} FROM base, {end} q)"
        steps, end = swept(f"w{i}_", f"w{i}", 4, range(3))
        near = " AND ".join(f"abs(q.a{j}_3 - c{j}) <= 1e-8 + {tol} * abs(c{j})" for j in (1, 2))
        const = f"abs((q.a0_3 - q.a1_3 * ma - q.a2_3 * mb) - (c0 - c1 * ma - c2 * mb)) <= 1e-8 + {tol} * abs(c0 - c1 * ma - c2 * mb)"
        keep = lambda old, new: f"CASE WHEN done THEN {old} ELSE {new} END"
        out += steps + f""",
s{i} AS MATERIALIZED (SELECT {', '.join(f"{keep(f'c{j}', f'q.a{j}_3')} AS c{j}" for j in range(3))}, done OR ({near} AND {const}) AS done, rounds + (NOT done)::INT AS rounds
  FROM s{i - 1}, {end} q, m)"""
    return out + f"""
SELECT 'const' AS term, round(c0 - c1 * ma - c2 * mb, {digits}) + 0.0 AS coef, rounds AS iterations, done AS converged FROM s{rounds}, m
UNION ALL SELECT 'l_quantity', round(c1, {digits}) + 0.0, rounds, done FROM s{rounds} UNION ALL SELECT 'l_discount', round(c2, {digits}) + 0.0, rounds, done FROM s{rounds}"""


def backward_sql(source: str, predictors: Sequence[str]) -> str:
    """Every subset's BIC from one set of cross-products, then drops one predictor after another while that lowers it."""
    k = len(predictors)
    names = [*predictors, "y"]
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(names))
    out = f"""
WITH RECURSIVE r AS (SELECT * FROM ({source})),
m AS (SELECT count(*)::DOUBLE AS n, {means} FROM r),
g AS MATERIALIZED (SELECT {products([f'({c} - m{i})' for i, c in enumerate(names)])} FROM r, m)"""
    fits = []
    for mask in range(1 << k):
        pivots = [i for i in range(k) if mask >> i & 1]
        steps, end = swept(f"k{mask}_", "g", k + 1, pivots)
        out += steps
        fits.append(f"SELECT {mask} AS mask, a{k}_{k} AS ssr, {len(pivots)} AS k FROM {end}")
    label = "CASE " + " ".join(f"WHEN gone = {1 << i} THEN '{c}'" for i, c in enumerate(predictors)) + " END"
    return out + f""",
b AS MATERIALIZED (SELECT mask, n * (ln(2 * pi()) + ln(ssr / n) + 1) + (k + 1) * ln(n) AS bic FROM ({' UNION ALL '.join(fits)}), m),
d AS MATERIALIZED (SELECT x.mask, y.mask AS next, y.bic, x.mask - y.mask AS gone FROM b x JOIN b y ON (x.mask & y.mask) = y.mask AND bit_count(x.mask) = bit_count(y.mask) + 1 AND y.bic < x.bic),
best AS MATERIALIZED (SELECT mask, arg_min(next, bic) AS next, arg_min(gone, bic) AS gone, min(bic) AS bic FROM d GROUP BY mask),
walk AS (SELECT 1 AS step, next, gone, bic FROM best WHERE mask = {(1 << k) - 1} UNION ALL SELECT step + 1, best.next, best.gone, best.bic FROM walk JOIN best ON best.mask = walk.next)
SELECT step::BIGINT AS step, {label} AS predictor, round(bic, 2) AS score FROM walk"""
