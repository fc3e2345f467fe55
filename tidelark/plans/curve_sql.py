"""The curve queries in SQL: pillars solved one after the other by a recursion over the instruments of every curve."""

from __future__ import annotations

from .dates import CAL


def third_wednesday(month: str) -> str:
    return f"({month} + CAST((2 - (isodow({month}) - 1) + 7) % 7 + 14 AS INT))"


def log_df(x: str, ts: str = "ts", ls: str = "ls") -> str:
    """The logarithm of the discount factor at x; ts and ls are lists of pillars."""
    k = f"greatest(1, least(len({ts}) - 1, len(list_filter({ts}, lambda z: z < {x}))))"
    return f"(CASE WHEN len({ts}) = 1 THEN {ls}[1] ELSE {ls}[{k}] + ({ls}[{k} + 1] - {ls}[{k}]) * ({x} - {ts}[{k}]) / ({ts}[{k} + 1] - {ts}[{k}]) END)"


def df(x: str, ts: str = "ts", ls: str = "ls") -> str:
    return f"exp({log_df(x, ts, ls)})"


def annuity(n: str) -> str:
    """What the first n coupons (lists ct, ca) of 1 are worth."""
    return f"coalesce(list_sum(list_transform(range(1, CAST({n} + 1 AS BIGINT)), lambda j: ca[j] * {df('ct[j]')})), 0)"


def coupons(source: str, name: str, key: str) -> str:
    """(key, ct, ca): the annual coupons between ef and mat of a source's rows, as lists."""
    return f"""{name}0 AS (SELECT {key}, td, ef, mat, n, mf FROM {source}, range(1, 60) r(n) JOIN cal ON cal.d = CAST(ef + to_years(n::INT) AS DATE)), {name}1 AS (SELECT *, lag(mf) OVER (PARTITION BY {key} ORDER BY n) AS pm FROM {name}0),
{name}2 AS (SELECT {key}, td, ef, n, CASE WHEN mf < mat THEN mf ELSE mat END AS cd FROM {name}1 WHERE n = 1 OR pm < mat), {name}3 AS (SELECT *, (cd - coalesce(lag(cd) OVER (PARTITION BY {key} ORDER BY n), ef)) / 360.0::DOUBLE AS alpha FROM {name}2),
{name} AS (SELECT {key}, list((cd - td) / 360.0::DOUBLE ORDER BY n) AS ct, list(alpha ORDER BY n) AS ca FROM {name}3 GROUP BY {key})"""


def instruments(trade: str, tenors: tuple) -> str:
    """ins: the instruments with their dates; cu: the customers' curves, with what their quotes and convexity come from."""
    value = lambda i, s, n, k: f"({i}, '{s}', '{k}', {n[:-1] if k == 'Swap' else 0}, {repr(month_of(s)) + '::DATE' if k == 'Future' else 'NULL::DATE'})"
    month_of = lambda s: f"202{s[-1]}-{'FGHJKMNQUVXZ'.index(s[-2]) + 1:02d}-01"
    return f"""{CAL}, day AS (SELECT c1.d AS td, c1.next_bd AS sp, c2.next_bd AS ef, c3.mf AS year1 FROM cal c1 JOIN cal c2 ON c2.d = c1.next_bd JOIN cal c3 ON c3.d = CAST(c1.d + INTERVAL 1 YEAR AS DATE) WHERE c1.d = DATE '{trade}'),
ten AS (SELECT * FROM (VALUES {", ".join(value(i, *t) for i, t in enumerate(tenors))}) v(i, symbol, type, years, f)),
i0 AS (SELECT i, symbol, type, td, ef, year1, CASE WHEN type = 'Future' THEN {third_wednesday('f')} END AS st, CASE type WHEN 'Rate' THEN sp WHEN 'Swap' THEN cal.mf ELSE {third_wednesday('CAST(f + INTERVAL 3 MONTH AS DATE)')} END AS mat FROM ten CROSS JOIN day LEFT JOIN cal ON cal.d = CAST(ef + to_years(years) AS DATE)),
il AS (SELECT * FROM i0 WHERE type = 'Swap' AND mat > year1), {coupons('il', 'ic', 'i')},
ins AS (SELECT i0.*, (mat - td) / 360.0::DOUBLE AS t, (ef - td) / 360.0::DOUBLE AS te, (st - td) / 360.0::DOUBLE AS t1, CASE type WHEN 'Future' THEN (mat - st) / 360.0::DOUBLE WHEN 'Swap' THEN (mat - ef) / 360.0::DOUBLE END AS alpha, prev_bd, ct, ca FROM i0 LEFT JOIN ic USING (i) LEFT JOIN cal ON cal.d = mat),
cu AS (SELECT c_custkey AS curve_id, 2.0::DOUBLE + (c_custkey % 100) / 50.0::DOUBLE AS level, 0.03::DOUBLE AS hw, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 90 + 10) / 10000.0::DOUBLE ELSE 0.006::DOUBLE END AS sg FROM customer)"""


CONVEXITY = "(CASE WHEN type = 'Future' THEN sg * sg / 2 * (1 - exp(-hw * (t - greatest(t1, 0)))) / hw * ((1 - exp(-hw * t)) / hw * exp(-hw * t) + (1 - exp(-2 * hw * greatest(t1, 0))) / (2 * hw)) ELSE 0 END)"


def bootstrap(name: str, source: str = "cu", keys: str = "curve_id", bump: str = "0") -> str:
    """name(keys, level, hw, sg, ts, ls, status): the curves of a source; bump is added to the quotes, in percent of rate."""
    rate = "(level + i * 0.05::DOUBLE + bumped) / 100"
    solved = f"""CASE type WHEN 'Rate' THEN 1 / (1 + rr * t) WHEN 'Future' THEN {df('greatest(t1, 0)')} / (1 + (rr - conv) * alpha) ELSE CASE WHEN ct IS NULL THEN {df('te')} / (1 + rr * alpha) ELSE ({df('te')} - rr * {annuity('len(ct) - 1')}) / (1 + rr * ca[-1]) END END"""
    return f"""{name}_r AS (SELECT {keys}, level, hw, sg, [0.0::DOUBLE] AS ts, [0.0::DOUBLE] AS ls, NULL::VARCHAR AS status, 0 AS n FROM {source}
 UNION ALL SELECT {keys}, level, hw, sg, CASE WHEN ok THEN list_append(ts, t) ELSE ts END, CASE WHEN ok THEN list_append(ls, ln(dfv)) ELSE ls END, coalesce(status, w), n + 1
 FROM (SELECT *, status IS NULL AND w IS NULL AS ok FROM (SELECT *, CASE WHEN t <= ts[-1] THEN 't does not increase at ' || symbol WHEN dfv IS NULL OR dfv <= 0 THEN 'discount factor not positive at ' || symbol WHEN ln(dfv) > ls[-1] THEN 'discount factor increases at ' || symbol END AS w
  FROM (SELECT *, {solved} AS dfv FROM (SELECT *, {rate} AS rr FROM (SELECT b.*, x.*, {CONVEXITY} AS conv, {bump} AS bumped FROM {name}_r b JOIN ins x ON x.i = b.n) q0) q1) q2) q3) q4),
{name} AS (SELECT * FROM {name}_r WHERE n = (SELECT count(*) FROM ins))"""


def pillar_table(curves: str) -> str:
    """pil: one row a pillar of curves, with rates in percent and repricing errors in basis points."""
    model = f"CASE type WHEN 'Rate' THEN 100 * (1 / d - 1) / t WHEN 'Future' THEN 100 * (1 - ({df('greatest(t1, 0)')} / d - 1) / alpha - conv) ELSE CASE WHEN ct IS NULL THEN 100 * ({df('te')} / d - 1) / alpha ELSE 100 * ({df('te')} - d) / {annuity('len(ct)')} END END"
    return f"""pil AS (SELECT curve_id, td AS trade_date, i + 1 AS pillar_no, symbol, mat, t, d AS df, 100 * CASE WHEN mat <= year1 THEN (1 / d - 1) / t ELSE d ** (-1 / t) - 1 END AS zero, 100 * ({df('(prev_bd - td) / 360.0::DOUBLE')} / d - 1) * 360 / (mat - prev_bd) AS forward_1d,
 100 * 360 * ((1 / d) ** (1.0::DOUBLE / (mat - td)) - 1) AS flat, 100 * ({model} - CASE WHEN type = 'Future' THEN 100 - (level + i * 0.05::DOUBLE) ELSE level + i * 0.05::DOUBLE END) AS error_bp
 FROM (SELECT c.*, x.*, exp(c.ls[x.i + 2]) AS d, {CONVEXITY} AS conv FROM {curves} c CROSS JOIN ins x WHERE status IS NULL) p)"""


def grid(tenors: tuple) -> str:
    """gr: the tenors of the grid with their dates and coupons."""
    span = {"D": "to_days({n})", "W": "to_days(7 * {n})", "M": "to_months({n})", "Y": "to_years({n})"}
    value = lambda g: f"('{g}', CAST({'td' if g[-1] in 'DW' else 'ef'} + {span[g[-1]].format(n=g[:-1])} AS DATE))"
    return f"""g0 AS (SELECT tenor, raw, td, ef, year1 FROM day, LATERAL (VALUES {", ".join(value(g) for g in tenors)}) v(tenor, raw)), g1 AS (SELECT tenor, td, ef, year1, CASE WHEN right(tenor, 1) = 'D' THEN raw ELSE mf END AS mat FROM g0 JOIN cal ON cal.d = raw),
gl AS (SELECT * FROM g1 WHERE mat > year1), {coupons('gl', 'gc', 'tenor')},
gr AS (SELECT g1.*, prev_bd, (mat - td) / 360.0::DOUBLE AS t, (ef - td) / 360.0::DOUBLE AS te, (prev_bd - td) / 360.0::DOUBLE AS tp, (mat - ef) / 360.0::DOUBLE AS alpha, ct, ca FROM g1 LEFT JOIN gc USING (tenor) LEFT JOIN cal ON cal.d = mat)"""


def repriced(curves: str, name: str) -> str:
    """name: the rates of curves on the grid, in percent."""
    return f"""{name} AS (SELECT curve_id, td AS trade_date, tenor, mat, d AS df, 100 * CASE WHEN ct IS NULL THEN CASE WHEN alpha <> 0 THEN (de / d - 1) / alpha END ELSE (de - d) / {annuity('len(ct)')} END AS par, 100 * ({df('tp')} / d - 1) * 360 / (mat - prev_bd) AS forward_1d,
 100 * 360 * ((1 / d) ** (1.0::DOUBLE / (mat - td)) - 1) AS flat FROM (SELECT c.curve_id, c.ts, c.ls, g.*, {df('g.t', 'c.ts', 'c.ls')} AS d, {df('g.te', 'c.ts', 'c.ls')} AS de FROM {curves} c CROSS JOIN gr g WHERE status IS NULL) p)"""
