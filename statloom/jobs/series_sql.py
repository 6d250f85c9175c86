"""SQL of the time-series queries, written out step by step from the textbook formulas."""

from __future__ import annotations

HOURLY = "SELECT event_type AS series, date_trunc('hour', ts) AS moment, sum(value) AS y FROM events GROUP BY ALL"
PLACED = f"s AS (SELECT series, moment, y, row_number() OVER (PARTITION BY series ORDER BY moment) - 1 AS place, count(*) OVER (PARTITION BY series) AS n, y - avg(y) OVER (PARTITION BY series) AS e FROM ({HOURLY}))"


def _regressed_out(name: str, source: str, out: str, rest: list[str], alive: str = "true") -> str:
    """A step of Gram-Schmidt: column ``out`` is regressed out of ``rest``, within series."""
    cells = ", ".join(f"{c} - CASE WHEN {alive} THEN coalesce(sum({c} * {out}) OVER w / nullif(sum({out} * {out}) OVER w, 0), 0) ELSE 0 END * {out} AS {c}" for c in rest)
    return f",\n{name} AS MATERIALIZED (SELECT * EXCLUDE ({', '.join(rest)}), {cells} FROM {source} WINDOW w AS (PARTITION BY series))"


def stationarity_sql(most: int = 24) -> str:
    """ADF by successive regressions on lags, of which a series takes those up to its own ``most``; KPSS by sums of products."""
    lags = [f"x{k}" for k in range(1, most + 1)]
    lagged = ", ".join(f"CASE WHEN {k} <= most THEN coalesce(lag(d, {k}) OVER o, 0) ELSE 0 END AS x{k}" for k in range(1, most + 1))
    head = f"""
WITH {PLACED},
m AS (SELECT *, least(ceil(12 * power(n / 100.0, 0.25)), n // 2 - 2)::BIGINT AS most, lead(e) OVER (PARTITION BY series ORDER BY place) - e AS d FROM s),
t AS (SELECT series, place, n, most, e AS level, d, {lagged} FROM m WINDOW o AS (PARTITION BY series ORDER BY place)),
c AS MATERIALIZED (SELECT *, 1.0 AS one FROM t WHERE d IS NOT NULL),
a AS (SELECT * FROM c WHERE place >= most)"""
    steps, before = _regressed_out("a0", "a", "one", ["level", "d", *lags]), "a0"
    scores = ["SELECT series, 0 AS k, any_value(most) AS most, count(*) AS rows, sum(d * d) - sum(d * level)^2 / sum(level * level) AS ssr FROM a0 GROUP BY series"]
    for k in range(1, most + 1):
        steps += _regressed_out(f"a{k}", before, f"x{k}", ["level", "d", *lags[k:]])
        before = f"a{k}"
        scores.append(f"SELECT series, {k}, any_value(most), count(*), sum(d * d) - sum(d * level)^2 / sum(level * level) FROM a{k} GROUP BY series")
    steps += f""",
aic AS (SELECT series, k, rows * (ln(2 * pi() * ssr / rows) + 1) + 2 * (k + 2) AS aic FROM ({' UNION ALL '.join(scores)}) WHERE k <= most),
best AS MATERIALIZED (SELECT series, arg_min(k, aic) AS k, min(aic) AS aic FROM aic GROUP BY series),
b AS (SELECT c.*, k FROM c JOIN best USING (series) WHERE place >= k)"""
    steps += _regressed_out("b0", "b", "one", ["level", "d", *lags])
    before = "b0"
    for k in range(1, most + 1):
        steps += _regressed_out(f"b{k}", before, f"x{k}", ["level", "d", *lags[k:]], f"{k} <= k")
        before = f"b{k}"
    return head + steps + f""",
adf AS (SELECT series, sum(d * level) / sum(level * level) / sqrt((sum(d * d) - sum(d * level)^2 / sum(level * level)) / (count(*) - any_value(k) - 2) / sum(level * level)) AS adf FROM {before} GROUP BY series),
near AS MATERIALIZED (SELECT p.series, p.n, p.place - q.place AS i, sum(p.e * q.e) AS g FROM s p JOIN s q ON p.series = q.series AND p.place - q.place BETWEEN 0 AND power(p.n, 2.0 / 9)::INT + 1 GROUP BY ALL),
wide AS (SELECT series, any_value(n) AS n, sum(g) FILTER (i = 0) / any_value(n) + sum(g) FILTER (i BETWEEN 1 AND floor(power(n, 2.0 / 9))) / (any_value(n) / 2.0) AS s0, sum(i * g) FILTER (i BETWEEN 1 AND floor(power(n, 2.0 / 9))) / (any_value(n) / 2.0) AS s1 FROM near GROUP BY series),
band AS (SELECT series, n, least(floor(1.1447 * power((s1 / s0)^2, 1.0 / 3) * power(n, 1.0 / 3)), n - 1)::BIGINT AS lags FROM wide),
long AS (SELECT series, any_value(lags) AS lags, sum(CASE WHEN p.place = q.place THEN 1 ELSE 2 * (1 - (p.place - q.place) / (lags + 1.0)) END * p.e * q.e) AS v FROM s p JOIN band USING (series) JOIN s q USING (series) WHERE p.place - q.place BETWEEN 0 AND lags GROUP BY series),
path AS (SELECT series, any_value(n) AS n, sum(total^2) AS q FROM (SELECT series, n, sum(e) OVER (PARTITION BY series ORDER BY place) AS total FROM s) GROUP BY series),
kpss AS (SELECT series, n, lags, q / n / v AS kpss FROM long JOIN path USING (series))
SELECT series, n, round(adf, 4) AS adf, k::INT AS adf_lags, round(aic, 3) AS adf_aic, round(kpss, 4) AS kpss, lags::INT AS kpss_lags,
       round(CASE WHEN kpss <= 0.347 THEN 0.1 WHEN kpss < 0.463 THEN 0.1 - (kpss - 0.347) / 0.116 * 0.05 WHEN kpss < 0.574 THEN 0.05 - (kpss - 0.463) / 0.111 * 0.025 WHEN kpss < 0.739 THEN 0.025 - (kpss - 0.574) / 0.165 * 0.015 ELSE 0.01 END, 4) AS kpss_p
FROM adf JOIN best USING (series) JOIN kpss USING (series)"""


def _loess(name: str, source: str, keys: str, span: int, low: str, high: str) -> str:
    """Local lines of ``source`` (keys, i, v, len) at the places from ``low`` to ``high``."""
    on = " AND ".join(f"p.{k} = s.{k}" for k in keys.split(", "))
    first = f"greatest(0, least(i - least({span}, len) // 2, len - least({span}, len)))"
    return f""",
{name}p AS MATERIALIZED (SELECT {keys}, len, i, {first} AS a, {first} + least({span}, len) - 1 AS b FROM (SELECT {keys}, len, unnest(range({low}, {high})) AS i FROM (SELECT {keys}, any_value(len) AS len FROM {source} GROUP BY {keys}))),
{name}u AS MATERIALIZED (SELECT {keys.replace('series', 'p.series').replace('phase', 'p.phase')}, p.len, p.i, s.v, s.i - p.i AS u, greatest(abs(a - p.i), abs(b - p.i)) + greatest({span} - p.len, 0) / 2.0 AS h FROM {name}p p JOIN {source} s ON {on} AND s.i BETWEEN a AND b),
{name}w AS MATERIALIZED (SELECT *, CASE WHEN abs(u) < 0.001 * h THEN 1.0 WHEN abs(u) < 0.999 * h THEN power(1 - power(abs(u) / h, 3), 3) ELSE 0 END::DOUBLE AS w FROM {name}u),
{name} AS MATERIALIZED (SELECT {keys}, i, any_value(len) AS len, coalesce((sum(w * v) * sum(w * u * u) - sum(w * u) * sum(w * u * v)) / nullif(sum(w) * sum(w * u * u) - sum(w * u)^2, 0), sum(w * v) / sum(w)) AS v FROM {name}w GROUP BY {keys}, i)"""


def stl_sql(period: int, trend_span: int, low_span: int, tail: str, rounds: int = 5, seasonal: int = 7) -> str:
    out = f"""
WITH {PLACED},
y AS MATERIALIZED (SELECT series, moment, place AS i, n AS len, e AS y, y - e AS mean FROM s WHERE n >= {2 * period}),
trend0 AS (SELECT series, i, 0.0 AS v FROM y)"""
    for r in range(1, rounds + 1):
        out += f""",
flat{r} AS MATERIALIZED (SELECT y.series, y.i % {period} AS phase, y.i // {period} AS i, y.y - t.v AS v, count(*) OVER (PARTITION BY y.series, y.i % {period}) AS len FROM y JOIN trend{r - 1} t USING (series, i))"""
        out += _loess(f"cycle{r}", f"flat{r}", "series, phase", seasonal, "-1", "len + 1")
        out += f""",
c{r} AS MATERIALIZED (SELECT series, (i + 1) * {period} + phase AS i, v FROM cycle{r}),
ma{r} AS (SELECT series, i, avg(v) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND {period - 1} FOLLOWING) AS v FROM c{r}),
mb{r} AS (SELECT series, i, avg(v) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND {period - 1} FOLLOWING) AS v FROM ma{r}),
mc{r} AS (SELECT series, i, avg(v) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS v FROM mb{r}),
pass{r} AS MATERIALIZED (SELECT m.series, m.i, m.v, y.len FROM mc{r} m JOIN y USING (series, i))"""
        out += _loess(f"low{r}", f"pass{r}", "series", low_span, "0", "len")
        out += f""",
season{r} AS MATERIALIZED (SELECT l.series, l.i, c.v - l.v AS v FROM low{r} l JOIN c{r} c ON c.series = l.series AND c.i = l.i + {period}),
rest{r} AS MATERIALIZED (SELECT y.series, y.i, y.len, y.y - s.v AS v FROM y JOIN season{r} s USING (series, i))"""
        out += _loess(f"trend{r}", f"rest{r}", "series", trend_span, "0", "len")
    return out + f""",
parts AS (SELECT y.series, y.moment, y.y + y.mean AS observed, t.v + y.mean AS trend, s.v AS seasonal, y.y - t.v - s.v AS residual FROM y JOIN trend{rounds} t USING (series, i) JOIN season{rounds} s USING (series, i))
{tail}"""


def ar1_sql() -> str:
    """Exact likelihood of a first-order autoregression from six sums, climbed by a search that keeps two thirds of its bracket."""

    def mean(phi: str) -> str:
        return f"((1 - {phi}^2) * e1 + (1 - {phi}) * (s2 - {phi} * s1)) / ((1 - {phi}^2) + (n - 1) * (1 - {phi})^2)"

    def squares(phi: str) -> str:
        m = f"({mean(phi)})"
        a, b, c = f"(q2 - 2 * {m} * s2 + (n - 1) * {m}^2)", f"(x - {m} * (s1 + s2) + (n - 1) * {m}^2)", f"(q1 - 2 * {m} * s1 + (n - 1) * {m}^2)"
        return f"((1 - {phi}^2) * (e1 - {m})^2 + {a} - 2 * {phi} * {b} + {phi}^2 * {c})"

    def height(phi: str) -> str:
        return f"(-0.5 * (n * ln(2 * pi() * {squares(phi)} / n) + n) + 0.5 * ln(1 - {phi}^2))"

    left, right = "(lo + (hi - lo) / 3)", "(hi - (hi - lo) / 3)"
    return f"""
WITH RECURSIVE {PLACED},
l AS (SELECT series, n, e, y - e AS shift, lag(e) OVER (PARTITION BY series ORDER BY place) AS b FROM s),
m AS (SELECT series, any_value(n)::DOUBLE AS n, avg(shift) AS shift, sum(e) FILTER (b IS NULL) AS e1, sum(e) FILTER (b IS NOT NULL) AS s2, sum(b) AS s1, sum(e * e) FILTER (b IS NOT NULL) AS q2, sum(b * b) AS q1, sum(e * b) AS x FROM l GROUP BY series),
r AS (SELECT *, -0.9999::DOUBLE AS lo, 0.9999::DOUBLE AS hi, 0 AS k FROM m
      UNION ALL SELECT series, n, shift, e1, s2, s1, q2, q1, x, CASE WHEN {height(left)} < {height(right)} THEN {left} ELSE lo END, CASE WHEN {height(left)} < {height(right)} THEN hi ELSE {right} END, k + 1 FROM r WHERE k < 60),
f AS (SELECT *, (lo + hi) / 2 AS phi FROM r WHERE k = 60)
SELECT series, n::BIGINT AS n, round(shift + {mean('phi')}, 3) AS const, round(phi, 4) AS ar, round({squares('phi')} / n, 2) AS sigma2, round({height('phi')}, 3) AS llf FROM f"""
