"""Queries on curves, policy scenarios, bonds and deliveries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import numeric as nm
from ..operators import curves as c
from ..operators import intervals as iv
from ..operators import policy as po
from ..sources import sheets
from . import curve_sql as cs
from .dates import CAL
from .ingest import landed
from .panel import rounded
from .tables import read

TRADE = "2026-02-23"
#: Policy meetings after the trade date.
MEETINGS = ("2026-03-18", "2026-04-29", "2026-06-17", "2026-07-29", "2026-09-16", "2026-10-28", "2026-12-09", "2027-01-27")
TENORS = (("ON", "1B", "Rate"), ("SOFR3Z5", "3M", "Future"), ("SOFR3H6", "3M", "Future"), ("SOFR3M6", "3M", "Future"), ("SOFR3U6", "3M", "Future"), ("2Y", "2Y", "Swap"), ("3Y", "3Y", "Swap"), ("4Y", "4Y", "Swap"), ("5Y", "5Y", "Swap"), ("7Y", "7Y", "Swap"), ("10Y", "10Y", "Swap"), ("15Y", "15Y", "Swap"), ("20Y", "20Y", "Swap"), ("30Y", "30Y", "Swap"))
Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def instruments(spark, d):
    """A curve a customer: quotes rise with the tenor from a level that the key gives."""
    t = spark.createDataFrame([(s, n, k, i) for i, (s, n, k) in enumerate(TENORS)], "symbol string, tenor string, type string, i int")
    cust = read(spark, d, "customer").select(F.col("c_custkey").alias("curve_id"), (F.lit(2.0) + (F.col("c_custkey") % 100) / 50.0).alias("level"))
    rate = F.col("level") + F.col("i") * 0.05
    q = cust.join(F.broadcast(t))  # 14 instruments a curve, of which one future accrues already
    return q.select("curve_id", F.to_date(F.lit(TRADE)).alias("trade_date"), "symbol", "tenor", "type", F.when(F.col("type") == "Future", 100 - rate).otherwise(rate).alias("quote"))


def params(spark, d):
    return read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("curve_id"), F.to_date(F.lit(TRADE)).alias("trade_date"), F.lit(None).cast("double").alias("hw_a"), ((F.col("c_custkey") % 90 + 10) / 10000.0).alias("hw_sigma"))


def rows(spark, d):
    return c.curve_rows(instruments(spark, d), params(spark, d))


def curves(spark, d):
    return c.bootstrap(rows(spark, d))


CURVES = f"WITH RECURSIVE {cs.instruments(TRADE, TENORS)}, {cs.bootstrap('cv')}"


@query("c1_bootstrap", CURVES + f" SELECT curve_id, DATE '{TRADE}' AS trade_date, status, round(t, 8) AS t, round(exp(l), 8) AS df FROM (SELECT curve_id, status, unnest(ts) AS t, unnest(ls) AS l FROM cv) p")
def bootstrap(spark, d):
    b = curves(spark, d)
    return b.select("curve_id", "trade_date", "status", F.explode(F.arrays_zip("ts", "ls")).alias("p")).select("curve_id", "trade_date", "status", F.round("p.ts", 8).alias("t"), F.round(F.exp("p.ls"), 8).alias("df"))


@query("s9_quote_sheets", S["c1_bootstrap"])
def quote_sheets(spark, d):
    """The curves of c1 from a workbook each of quotes, trade date and volatility."""
    q = instruments(spark, d).groupBy("curve_id", "trade_date").agg(F.collect_list(F.struct("symbol", "tenor", "type", "quote")).alias("rows"))  # 14 a curve
    q = q.join(params(spark, d).select("curve_id", "hw_sigma"), "curve_id", "left")

    def books(batches):
        for b in batches:
            files = []
            for day, rows, sigma in zip(*(b.column(c).to_pylist() for c in ("trade_date", "rows", "hw_sigma")), strict=True):
                table = [["Symbol", "Tenors", "Type", "Quote"], *([r["symbol"], r["tenor"], r["type"], r["quote"]] for r in rows), ["end of quotes"]]
                table[1] += [None, day]
                table[7] += [None] * 11 + [None if sigma is None else 100 * sigma]
                files.append(sheets.workbook({"Quotes": table}))
            yield pa.RecordBatch.from_arrays([b.column("curve_id").cast(pa.string()), pa.array(files, pa.binary())], ["path", "content"])

    rows = sheets.parse_sheets(q.mapInArrow(books, "path string, content binary"), 0)
    i, p = sheets.quotes(spark.read.schema(rows.schema).parquet(landed(rows, "parquet")))  # read several times, parsed once
    b = c.bootstrap(c.curve_rows(i, p))
    b = b.select(F.col("curve_id").cast("long").alias("curve_id"), "trade_date", "status", F.explode(F.arrays_zip("ts", "ls")).alias("p"))
    return b.select("curve_id", "trade_date", "status", F.round("p.ts", 8).alias("t"), F.round(F.exp("p.ls"), 8).alias("df"))


@query("c2_pillars", CURVES + f", {cs.pillar_table('cv')} SELECT curve_id, trade_date, pillar_no, symbol, mat, round(t, 6) AS t, round(df, 6) AS df, round(zero, 6) AS zero, round(forward_1d, 6) AS forward_1d, round(flat, 6) AS flat, round(abs(error_bp), 6) AS error_bp FROM pil")
def pillars(spark, d):
    return rounded(c.pillars(curves(spark, d)).withColumn("error_bp", F.abs("error_bp")))


@query("j12_interval_discounts", CURVES + f""", tt AS (SELECT o_orderkey, o_custkey AS curve_id, (CAST(o_orderdate AS DATE) - DATE '1994-01-01') / 60.0::DOUBLE AS t FROM orders)
SELECT o_orderkey, curve_id, round(t, 8) AS t, round(CASE WHEN status IS NULL THEN {cs.df('t')} END, 8) AS df FROM tt LEFT JOIN cv USING (curve_id)""")
def interval_discounts(spark, d):
    """The discount factor on its customer's curve at a time that each order's date gives, some before the curve and some beyond its end."""
    p = curves(spark, d).where("status IS NULL").select("curve_id", F.explode(F.arrays_zip("ts", "ls")).alias("p")).select("curve_id", F.col("p.ts").alias("t"), F.col("p.ls").alias("l"))
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1994-01-01").cast("date"))
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("curve_id"), (days / 60.0).alias("t"))
    return iv.discount_factors_at(p, o, ["curve_id"]).select("o_orderkey", "curve_id", F.round("t", 8).alias("t"), F.round("df", 8).alias("df"))


FORWARD = f"(-({cs.log_df('(tk + 1e-6)')} - {cs.log_df('greatest(tk - 1e-6, 0.0)')}) / 2e-6)"


@query("g18_fit_quality", CURVES + f""", {cs.pillar_table('cv')}, fw AS (SELECT curve_id, min({FORWARD}) AS f FROM (SELECT curve_id, ts, ls, 0.5 + (ts[-1] - 0.5) * k / 19.0::DOUBLE AS tk FROM cv, range(0, 20) r(k) WHERE status IS NULL) p GROUP BY curve_id)
SELECT curve_id, trade_date, round(max(abs(error_bp)), 6) AS max_error_bp, round(min(df), 6) AS min_df, round(max(zero), 6) AS max_zero, round(min(zero), 6) AS min_zero, count(*) AS pillars, round(max(t), 6) AS last_t, round(any_value(f), 6) AS min_forward, any_value(f) < -0.05 AS negative_forward FROM pil JOIN fw USING (curve_id) GROUP BY curve_id, trade_date""")
def quality(spark, d):
    return rounded(c.fit_quality(curves(spark, d)))


@query("c3_bucket_dv01", CURVES + f""", kk AS (SELECT cu.*, k FROM cu, range(0, {len(TENORS)}) r(k)), {cs.bootstrap('bp', 'kk', 'curve_id, k', "CASE WHEN i = k THEN 0.01::DOUBLE ELSE 0 END")}
SELECT curve_id, DATE '{TRADE}' AS trade_date, symbol, CASE WHEN bp.status IS NULL THEN round_even(list_sum(list_transform(range(1, len(bp.ls) + 1), lambda j: exp(bp.ls[j]) - exp(cv.ls[j]))), 8) END AS dv01 FROM bp JOIN cv USING (curve_id) JOIN ins ON ins.i = k WHERE cv.status IS NULL""")
def dv01(spark, d):
    return c.bucket_dv01(rows(spark, d))


@query("c4_tenor_grid", CURVES + f", {cs.grid(c.GRID)}, {cs.repriced('cv', 'rp')} SELECT curve_id, trade_date, tenor, mat, round(df, 6) AS df, round(par, 6) AS par, round(forward_1d, 6) AS forward_1d, round(flat, 6) AS flat FROM rp")
def grid(spark, d):
    return rounded(c.reprice_grid(curves(spark, d)))


UNIT = lambda x: f"round_even(greatest(0, least(1, {x})) * 100, 1)"


@query("c5_meeting_prices", CURVES + f""", mt AS (SELECT meeting_date, next_bd AS effective_date FROM (VALUES {', '.join(f"(DATE '{m}')" for m in MEETINGS)}) v(meeting_date) JOIN cal ON cal.d = meeting_date),
mr AS (SELECT curve_id, meeting_date, effective_date, effective_date - meeting_date AS n, ({cs.df("(meeting_date - DATE '2026-02-23') / 360.0::DOUBLE")} / {cs.df("(effective_date - DATE '2026-02-23') / 360.0::DOUBLE")} - 1) * 360 / (effective_date - meeting_date) AS r FROM cv, mt WHERE status IS NULL)
SELECT curve_id, DATE '{TRADE}' AS trade_date, meeting_date, effective_date, n::INT AS window_days, round_even(r * 100, 4) AS implied_pct, round_even((r - 0.03625::DOUBLE) * 10000, 2) AS diff_bp, {UNIT('(0.03625::DOUBLE - r) / 0.0025::DOUBLE')} AS p_cut_pct, {UNIT('(r - 0.03625::DOUBLE) / 0.0025::DOUBLE')} AS p_hike_pct,
 3.375::DOUBLE AS rate_if_cut, 3.875::DOUBLE AS rate_if_hike, 3.625::DOUBLE AS rate_if_hold FROM mr""")
def meeting_prices(spark, d):
    m = spark.createDataFrame([(x,) for x in MEETINGS], "d string").select(F.to_date("d").alias("meeting_date"))
    return c.price_meetings(curves(spark, d), m, 0.03625)


@query("j16_curve_comparison", CURVES + f""", {cs.bootstrap('mv', bump="CASE WHEN type = 'Swap' THEN 0.01::DOUBLE ELSE 0 END")}, {cs.grid(c.GRID)}, {cs.repriced('cv', 'ra')}, {cs.repriced('mv', 'rb')}, df AS (SELECT tenor, abs(rb.par - ra.par) * 100 AS x FROM ra JOIN rb USING (curve_id, tenor))
SELECT tenor, round(max(x), 4) AS max_abs, round(avg(x), 4) AS mean_abs, count(*) FILTER (x > 1e-6) AS mismatches, count(*) AS n FROM df GROUP BY tenor""")
def curve_comparison(spark, d):
    moved = instruments(spark, d).withColumn("quote", F.when(F.col("type") == "Swap", F.col("quote") + 0.01).otherwise(F.col("quote")))
    b = c.bootstrap(c.curve_rows(moved, params(spark, d)))
    return rounded(c.comparison_summary(c.compare_grids(c.grids(curves(spark, d)), c.grids(b), "par"), ["tenor"]), 4)



SCHED = f"""{CAL}, b AS (SELECT o_orderkey AS curve_id, CAST(o_orderdate AS DATE) AS eff, CAST(CAST(o_orderdate AS DATE) + INTERVAL 5 YEAR AS DATE) AS mat FROM orders),
u0 AS (SELECT curve_id, eff, mat, n::INT AS coupon_no, CAST(eff + to_years(n::INT) AS DATE) AS un FROM b, range(1, 7) r(n)), s0 AS (SELECT u0.*, mf FROM u0 JOIN cal ON cal.d = un),
s1 AS (SELECT *, lag(mf) OVER (PARTITION BY curve_id ORDER BY coupon_no) AS pm FROM s0), sa AS (SELECT curve_id, eff, coupon_no, CASE WHEN mf < mat THEN mf ELSE mat END AS cd FROM s1 WHERE coupon_no = 1 OR pm < mat),
sb AS (SELECT curve_id, eff, coupon_no, un AS cd FROM s0 WHERE coupon_no <= 5), ya AS (SELECT *, (cd - coalesce(lag(cd) OVER (PARTITION BY curve_id ORDER BY coupon_no), eff)) / 360.0::DOUBLE AS al FROM sa), yb AS (SELECT *, (cd - coalesce(lag(cd) OVER (PARTITION BY curve_id ORDER BY coupon_no), eff)) / 360.0::DOUBLE AS al FROM sb)"""


@query("j13_schedule_comparison", f"""WITH {SCHED} SELECT coalesce(ya.curve_id, yb.curve_id) AS curve_id, coalesce(ya.coupon_no, yb.coupon_no) AS coupon_no, ya.cd AS date_a, yb.cd AS date_b, (yb.cd - ya.cd)::INT AS days, round_even((round_even(yb.al, 8) - round_even(ya.al, 8)) * 360, 6) AS accrual_days,
 NOT (coalesce(yb.cd - ya.cd = 0, false) AND coalesce(round_even((round_even(yb.al, 8) - round_even(ya.al, 8)) * 360, 6) = 0, false)) AS differs FROM ya FULL JOIN yb ON ya.curve_id = yb.curve_id AND ya.coupon_no = yb.coupon_no""")
def schedules(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("curve_id"), F.col("o_orderdate").cast("date").alias("eff")).withColumn("mat", F.add_months("eff", 60))
    a = dt.annual_schedule(o, "eff", "mat").select("curve_id", "eff", "coupon_no", "coupon_date")
    b = o.select("curve_id", "eff", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("coupon_no")).withColumn("coupon_date", F.add_months("eff", 12 * F.col("coupon_no")))
    w = c.Window.partitionBy("curve_id").orderBy("coupon_no")
    alpha = lambda x: x.withColumn("alpha", dt.act_360(F.coalesce(F.lag("coupon_date").over(w), "eff"), F.col("coupon_date"))).drop("eff")
    return c.compare_schedules(alpha(a), alpha(b))


def bases(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("base_id"), (F.lit(0.03) + F.col("n_nationkey") * 0.0005).alias("initial_rate"))


def _paths(meetings, lo, hi):
    """All paths in SQL, with what each move adds."""
    parts = [f"m{i} AS (SELECT unnest(range({lo}, {hi + 1})) AS x{i})" for i in range(len(meetings))]
    width = hi - lo + 1
    raw = " + ".join(f"(x{i} - {lo}) * {width ** (len(meetings) - 1 - i)}" for i in range(len(meetings)))
    cuts = " + ".join(f"greatest(-x{i}, 0)" for i in range(len(meetings)))
    hikes = " + ".join(f"greatest(x{i}, 0)" for i in range(len(meetings)))
    cd = "nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN x{i} < 0 THEN '{m}' END" for i, m in enumerate(meetings)) + "), '')"
    hd = "nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN x{i} > 0 THEN '{m}' END" for i, m in enumerate(meetings)) + "), '')"
    return ", ".join(parts) + f", pp AS (SELECT {raw} AS raw, {cuts} AS total_cuts, {hikes} AS total_hikes, {cd} AS cut_dates, {hd} AS hike_dates FROM {', '.join(f'm{i}' for i in range(len(meetings)))})"


BASES = "bs AS (SELECT n_nationkey AS base_id, 0.03::DOUBLE + n_nationkey * 0.0005::DOUBLE AS initial_rate FROM nation)"


@query("c6_scenarios", f"WITH {BASES}, {_paths(MEETINGS, -1, 1)} SELECT base_id, CAST(raw AS BIGINT) AS scenario_id, CAST(total_cuts AS INT) AS total_cuts, CAST(total_hikes AS INT) AS total_hikes, cut_dates, hike_dates, round(initial_rate + (total_hikes - total_cuts) * 0.0025::DOUBLE, 6) AS terminal_rate FROM bs, pp WHERE total_cuts <= 2 AND total_hikes <= 2 AND initial_rate + (total_hikes - total_cuts) * 0.0025::DOUBLE >= 0.0301::DOUBLE")
def scenario_rows(spark, d):
    s = po.scenarios(bases(spark, d), list(MEETINGS), [-1, 0, 1], floor=0.0301)
    return s.select("base_id", F.col("scenario_id").cast("long").alias("scenario_id"), "total_cuts", "total_hikes", "cut_dates", "hike_dates", F.round("terminal_rate", 6).alias("terminal_rate"))


#: Initial rates of the customers' segments, floored and capped.
CAPPED = "bs AS (SELECT c_mktsegment AS base_id, 0.03::DOUBLE + max(c_custkey % 10) * 0.0005::DOUBLE AS initial_rate FROM customer GROUP BY 1)"


@query("p18_scenarios_capped", f"WITH {CAPPED}, {_paths(MEETINGS[:5], -1, 1)} SELECT base_id, CAST(raw AS BIGINT) AS scenario_id, CAST(total_cuts AS INT) AS total_cuts, CAST(total_hikes AS INT) AS total_hikes, round(initial_rate + (total_hikes - total_cuts) * 0.0025::DOUBLE, 6) AS terminal_rate FROM bs, pp WHERE total_cuts <= 2 AND total_hikes <= 2 AND initial_rate + (total_hikes - total_cuts) * 0.0025::DOUBLE BETWEEN 0.0311::DOUBLE AND 0.0361::DOUBLE")
def scenarios_capped(spark, d):
    b = read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("base_id")).agg((F.lit(0.03) + F.max(F.col("c_custkey") % 10) * 0.0005).alias("initial_rate"))
    s = po.scenarios(b, list(MEETINGS[:5]), [-1, 0, 1], floor=0.0311, cap=0.0361)
    return s.select("base_id", F.col("scenario_id").cast("long").alias("scenario_id"), "total_cuts", "total_hikes", F.round("terminal_rate", 6).alias("terminal_rate"))


@query("c6_scenarios_contiguous", f"WITH {BASES}, {_paths(MEETINGS, -2, 1)} SELECT base_id, row_number() OVER (PARTITION BY base_id ORDER BY raw) - 1 AS scenario_id, CAST(total_cuts AS INT) AS total_cuts, CAST(total_hikes AS INT) AS total_hikes, cut_dates, hike_dates, round(initial_rate + (total_hikes - total_cuts) * 0.0025::DOUBLE, 8) AS terminal_rate FROM bs, pp WHERE total_cuts <= 2 AND total_hikes <= 1")
def scenario_rows_contiguous(spark, d):
    s = po.scenarios(bases(spark, d), list(MEETINGS), [-2, -1, 0, 1], max_hikes=1, contiguous=True)
    return s.select("base_id", F.col("scenario_id").cast("long").alias("scenario_id"), "total_cuts", "total_hikes", "cut_dates", "hike_dates", F.round("terminal_rate", 8).alias("terminal_rate"))


H = 364
PATHS = f"""WITH {BASES}, {_paths(MEETINGS[:6], -1, 1)}, sc AS (SELECT base_id, initial_rate, raw AS scenario_id, cut_dates, hike_dates FROM bs, pp WHERE total_cuts <= 1 AND total_hikes <= 1),
dd AS (SELECT base_id, scenario_id, k AS day_idx, DATE '{TRADE}' + k::INT AS date, initial_rate - 0.0025::DOUBLE * len(list_filter(string_split(coalesce(cut_dates, ''), ', '), lambda x: x <> '' AND x <= strftime(DATE '{TRADE}' + k::INT, '%Y-%m-%d')))
 + 0.0025::DOUBLE * len(list_filter(string_split(coalesce(hike_dates, ''), ', '), lambda x: x <> '' AND x <= strftime(DATE '{TRADE}' + k::INT, '%Y-%m-%d'))) AS policy FROM sc, range(1, {H + 1}) r(k)),
pt AS (SELECT *, exp(-sum(ln(1 + (policy + 0.0005::DOUBLE) / 360)) OVER (PARTITION BY base_id, scenario_id ORDER BY day_idx)) AS df FROM dd)"""


def paths(spark, d):
    s = po.scenarios(bases(spark, d), list(MEETINGS[:6]), [-1, 0, 1], max_cuts=1, max_hikes=1)
    return po.daily_paths(s, TRADE, H, 0.0025, base=360.0, spread=0.0005)


@query("c7_daily_paths", PATHS + " SELECT base_id, CAST(scenario_id AS BIGINT) AS scenario_id, CAST(day_idx AS INT) AS day_idx, date, round(policy, 8) AS policy, round(df, 8) AS df FROM pt")
def daily(spark, d):
    return paths(spark, d).select("base_id", F.col("scenario_id").cast("long").alias("scenario_id"), "day_idx", "date", F.round("policy", 8).alias("policy"), F.round("df", 8).alias("df"))


@query("c8_accumulation", PATHS + " SELECT base_id, CAST(scenario_id AS BIGINT) AS scenario_id, round(exp(sum(ln(1 + (policy + 0.0005::DOUBLE) / 360))), 8) AS accum, round(2 * (exp(sum(ln(1 + (policy + 0.0005::DOUBLE) / 360))) ** 0.25 - 1), 8) AS yield_2y FROM pt GROUP BY base_id, scenario_id")
def accum(spark, d):
    return rounded(po.accumulation(paths(spark, d), 360.0), 8).withColumn("scenario_id", F.col("scenario_id").cast("long"))


YF = lambda y: f"(cp / 2 * 100 * CASE WHEN abs({y}) < 1e-12 THEN n ELSE (1 - (1 / (1 + {y} / 2)) ** n) / ({y} / 2) END + 100 * (1 / (1 + {y} / 2)) ** n)"

#: Bonds with a month more or less to run are priced alike but for their coupon: mm, the months, stands for a schedule.
BONDS = f"""WITH RECURSIVE {BASES}, {_paths(MEETINGS[:4], -1, 1)}, sc AS (SELECT base_id, initial_rate, raw AS scenario_id, cut_dates FROM bs, pp WHERE total_cuts <= 1 AND total_hikes <= 0),
dd AS (SELECT base_id, scenario_id, k AS day_idx, initial_rate - CASE WHEN CAST(cut_dates AS DATE) <= DATE '{TRADE}' + k::INT THEN 0.0025::DOUBLE ELSE 0 END AS policy FROM sc, range(1, 729) r(k)), pt AS (SELECT *, exp(-sum(ln(1 + policy / 364)) OVER (PARTITION BY base_id, scenario_id ORDER BY day_idx)) AS df FROM dd),
mm AS (SELECT DISTINCT 6 + p_partkey % 30 AS mm FROM part), pay AS (SELECT mm, DATE '{TRADE}' + to_months(mm::INT) AS mat, CAST(DATE '{TRADE}' + to_months((mm - 6 * k)::INT) AS DATE) AS d FROM mm, range(0, 8) r(k) WHERE mm - 6 * k > 0),
pd AS (SELECT *, (d - DATE '{TRADE}') / 365.0::DOUBLE * 364 AS days_on, least(728, floor((d - DATE '{TRADE}') / 365.0::DOUBLE * 364))::INT AS k FROM pay), pv AS (SELECT base_id, scenario_id, mm, d, mat, CASE WHEN k < 1 THEN y.df WHEN k >= 728 THEN x.df ELSE x.df + (y.df - x.df) * (days_on - k) END AS v FROM pd JOIN pt x ON x.day_idx = greatest(k, 1) JOIN pt y USING (base_id, scenario_id) WHERE y.day_idx = least(k + 1, 728)),
an AS (SELECT base_id, scenario_id, mm, sum(v) AS a, max(CASE WHEN d = mat THEN v END) AS z, count(*)::DOUBLE AS n, min(d) AS nxt FROM pv GROUP BY base_id, scenario_id, mm),
bd AS (SELECT base_id, scenario_id, p_partkey AS bond_id, p_size / 1000.0::DOUBLE AS cp, n, p_size / 1000.0::DOUBLE / 2 * 100 * a + 100 * z AS dirty, p_size / 1000.0::DOUBLE / 2 * 100 * (DATE '{TRADE}' - CAST(nxt - INTERVAL 6 MONTH AS DATE)) / (nxt - CAST(nxt - INTERVAL 6 MONTH AS DATE)) AS accrued FROM part JOIN an ON mm = 6 + p_partkey % 30),
ys AS (SELECT base_id, scenario_id, bond_id, cp, n, dirty, accrued, -0.5::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM bd
UNION ALL SELECT base_id, scenario_id, bond_id, cp, n, dirty, accrued, CASE WHEN above THEN mid ELSE lo END, CASE WHEN above THEN hi ELSE mid END, i + 1 FROM (SELECT *, {YF('mid')} > dirty AS above FROM (SELECT *, (lo + hi) / 2 AS mid FROM ys WHERE i < 60) q0) q1)"""


@query("c9_scenario_bonds", BONDS + f" SELECT base_id, CAST(scenario_id AS BIGINT) AS scenario_id, bond_id, round(dirty, 6) AS dirty, round(dirty - accrued, 6) AS clean, round(accrued, 6) AS accrued, CASE WHEN {YF('(-0.5::DOUBLE)')} >= dirty AND {YF('(1.0::DOUBLE)')} <= dirty THEN round((lo + hi) / 2, 6) END AS ytm FROM ys WHERE i = 60")
def bonds(spark, d):
    b = read(spark, d, "part").select(F.col("p_partkey").alias("bond_id"), (F.col("p_size") / 1000.0).alias("coupon"), F.add_months(F.to_date(F.lit(TRADE)), (6 + F.col("p_partkey") % 30).cast("int")).alias("maturity"))
    s = po.scenarios(bases(spark, d), list(MEETINGS[:4]), [-1, 0, 1], max_cuts=1, max_hikes=0)
    p = po.daily_paths(s, TRADE, 728, 0.0025, base=364.0, hikes=False)
    return rounded(po.price_bonds(p, b, TRADE, 364.0)).withColumn("scenario_id", F.col("scenario_id").cast("long"))


@query("c10_bond_yields", f"""WITH RECURSIVE b AS (SELECT p_partkey, p_size / 500.0::DOUBLE AS cp, (1 + p_partkey % 40)::DOUBLE AS n, p_retailprice / 10 AS dirty, -0.5::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM part
UNION ALL SELECT p_partkey, cp, n, dirty, CASE WHEN {YF('((lo + hi) / 2)')} > dirty THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {YF('((lo + hi) / 2)')} > dirty THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM b WHERE i < 60)
SELECT p_partkey, CASE WHEN {YF('(-0.5::DOUBLE)')} >= dirty AND {YF('(1.0::DOUBLE)')} <= dirty THEN round((lo + hi) / 2, 6) END AS ytm FROM b WHERE i = 60""")
def yields(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(po.yield_of(F.col("p_retailprice") / 10, F.col("p_size") / 500.0, (1 + F.col("p_partkey") % 40).cast("double")), 6).alias("ytm"))


BASKET = """bk AS (SELECT p_brand AS contract, CASE WHEN p_partkey % 2 = 0 THEN 'Mar-2026' ELSE 'Jun-2026' END AS delivery_month, 'B' || p_partkey AS cusip, CASE WHEN p_size % 10 <> 0 THEN 0.85::DOUBLE + p_size / 500.0::DOUBLE END AS cf, p_retailprice / 10 AS cash FROM part),
fu AS (SELECT p_brand AS contract, dm AS delivery_month, 100.0::DOUBLE + max(p_size) / 32.0::DOUBLE AS price, CASE dm WHEN 'Mar-2026' THEN DATE '2026-03-27' ELSE DATE '2026-06-30' END AS dd FROM part, (VALUES ('Mar-2026'), ('Jun-2026')) v(dm) GROUP BY p_brand, dm)"""


def basket(spark, d):
    part = read(spark, d, "part")
    b = part.select(F.col("p_brand").alias("contract"), F.when(F.col("p_partkey") % 2 == 0, "Mar-2026").otherwise("Jun-2026").alias("delivery_month"), F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("cusip"), F.when(F.col("p_size") % 10 != 0, F.lit(0.85) + F.col("p_size") / 500.0).alias("cf"), (F.col("p_retailprice") / 10).alias("cash"))
    f = part.groupBy(F.col("p_brand").alias("contract")).agg((F.lit(100.0) + F.max("p_size") / 32.0).alias("price"))
    f = f.withColumn("delivery_month", F.explode(F.array(F.lit("Mar-2026"), F.lit("Jun-2026")))).withColumn("delivery_date", F.when(F.col("delivery_month") == "Mar-2026", F.to_date(F.lit("2026-03-27"))).otherwise(F.to_date(F.lit("2026-06-30"))))
    return b, f


@query("c11_delivery_ranking", f"WITH {BASKET} SELECT contract, delivery_month, cusip, round(price * cf, 6) AS invoice, round(cash - price * cf, 6) AS gross_basis, round((price * cf - cash) * 360 / (cash * (dd - DATE '{TRADE}')), 6) AS implied_repo, rank() OVER (PARTITION BY contract, delivery_month ORDER BY (price * cf - cash) * 360 / (cash * (dd - DATE '{TRADE}')) DESC NULLS LAST, cusip)::INT AS rank FROM bk JOIN fu USING (contract, delivery_month) WHERE cf IS NOT NULL")
def delivery(spark, d):
    return rounded(po.rank_delivery(*basket(spark, d), TRADE).select("contract", "delivery_month", "cusip", "invoice", "gross_basis", "implied_repo", "rank"))


@query("j2_basket_auctions", f"WITH {BASKET} SELECT contract, delivery_month, cusip, cf, l_orderkey, l_linenumber, round(l_extendedprice, 2) AS accepted FROM bk LEFT JOIN lineitem ON cusip = 'B' || l_partkey WHERE cf IS NOT NULL")
def auctions(spark, d):
    b = basket(spark, d)[0].where("cf IS NOT NULL")
    a = read(spark, d, "lineitem").select(F.concat(F.lit("B"), F.col("l_partkey").cast("string")).alias("cusip"), "l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("accepted"))
    return b.join(a, "cusip", "left").select("contract", "delivery_month", "cusip", "cf", "l_orderkey", "l_linenumber", "accepted")


@query("t21_t22_rates", f"""WITH {CAL}, q AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS td, (30 * l_quantity)::INT + l_linenumber AS dy, l_discount FROM lineitem),
r AS (SELECT q.*, dy / 360.0::DOUBLE AS t, td + dy <= mf AS short, exp(-(0.02::DOUBLE + l_discount) * dy / 360.0::DOUBLE) AS df FROM q JOIN cal ON cal.d = CAST(td + INTERVAL 1 YEAR AS DATE))
SELECT l_orderkey, l_linenumber, short, round(100 * CASE WHEN short THEN (1 / df - 1) / t ELSE df ** (-1 / t) - 1 END, 6) AS zero, round(100 * 360 * ((1 / df) ** (1.0::DOUBLE / dy) - 1), 6) AS flat, round(100 * (df / (df * exp(-0.01::DOUBLE)) - 1) / 0.25::DOUBLE, 6) AS forward FROM r""")
def simple_rates(spark, d):
    """Maturities of 31 to 1,507 days from each ship date, those of 361 to 368 around a year's tenor among them."""
    days = (30 * F.col("l_quantity")).cast("int") + F.col("l_linenumber")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("td"), days.alias("dy"), (F.lit(0.02) + F.col("l_discount")).alias("r"))
    li = li.withColumns({"t": F.col("dy") / 360.0, "short": F.date_add("td", F.col("dy")) <= dt.add_tenor(F.col("td"), F.lit("1Y"))}).withColumn("df", F.exp(-F.col("r") * F.col("t")))
    return li.select("l_orderkey", "l_linenumber", "short", F.round(nm.zero_rate(F.col("df"), F.col("t"), F.col("short")), 6).alias("zero"), F.round(nm.flat_daily_rate(F.col("df"), F.col("dy")), 6).alias("flat"), F.round(nm.forward_rate(F.col("df"), F.col("df") * F.exp(F.lit(-0.01)), F.lit(0.25)), 6).alias("forward"))


@query("t20_convexity", """SELECT l_orderkey, l_linenumber, round(s * s / 2 * (1 - exp(-a * (t2 - t1))) / a * ((1 - exp(-a * t2)) / a * exp(-a * t2) + (1 - exp(-2 * a * t1)) / (2 * a)) * 10000, 8) AS bp
FROM (SELECT l_orderkey, l_linenumber, 0.03::DOUBLE AS a, 0.005::DOUBLE + l_discount / 10 AS s, l_quantity / 10.0::DOUBLE AS t1, l_quantity / 10.0::DOUBLE + 0.25::DOUBLE AS t2 FROM lineitem)""")
def convexity(spark, d):
    t1 = F.col("l_quantity") / 10.0
    bp = nm.hull_white_convexity(F.lit(0.03), F.lit(0.005) + F.col("l_discount") / 10, t1, t1 + 0.25) * 10000
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(bp, 8).alias("bp"))


@query("j15_pillar_dates", f"WITH {CAL}, b AS (SELECT o_orderkey AS curve_id, ([1, 3, 6, 12])[1 + o_orderkey % 4] AS m, CAST(CAST(o_orderdate AS DATE) + to_months(([1, 3, 6, 12])[1 + o_orderkey % 4]::INT) AS DATE) AS raw FROM orders) SELECT m::INT AS m, count(*) AS n, sum(CASE WHEN mf <> raw THEN 1 ELSE 0 END)::BIGINT AS moved, max(abs(mf - raw))::INT AS most_days FROM b JOIN cal ON raw = cal.d GROUP BY m")
def pillar_dates(spark, d):
    m = F.get(F.array(*(F.lit(x) for x in (1, 3, 6, 12))), (F.col("o_orderkey") % 4).cast("int"))
    o = read(spark, d, "orders").select(m.alias("m"), F.col("o_orderdate").cast("date").alias("b")).withColumn("tenor", F.concat(F.col("m").cast("string"), F.lit("M")))
    o = o.withColumn("mat", dt.add_tenor(F.col("b"), F.col("tenor"))).withColumn("days", F.datediff("mat", F.add_months("b", F.col("m"))))
    return o.groupBy("m").agg(F.count("*").alias("n"), F.count_if(F.col("days") != 0).alias("moved"), F.max(F.abs("days")).alias("most_days"))


@query("j15_pillar_comparison", f"""WITH {CAL}, b AS (SELECT o_orderkey AS curve_id, CAST(o_orderdate AS DATE) AS base, m, CAST(CAST(o_orderdate AS DATE) + to_months(m) AS DATE) AS raw FROM orders, (VALUES (6), (24), (36), (60)) v(m)),
c AS (SELECT curve_id, m || 'M' AS tenor, mf AS mat_a, raw AS mat_b, (raw - mf)::INT AS days, raw <> mf AS differs, CASE WHEN mf <= k.d3 THEN 'short' ELSE 'long' END AS panel FROM b JOIN cal ON cal.d = raw JOIN (SELECT d AS base, CAST(d + INTERVAL 36 MONTH AS DATE) AS d3 FROM cal) k USING (base))
SELECT * FROM c""")
def pillar_comparison(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("curve_id"), F.col("o_orderdate").cast("date").alias("base"), F.explode(F.array(*map(F.lit, (6, 24, 36, 60)))).alias("m")).withColumn("tenor", F.concat(F.col("m").cast("string"), F.lit("M")))
    a = o.withColumn("mat", dt.add_tenor(F.col("base"), F.col("tenor"))).withColumn("panel", c.panel_of(F.col("mat"), F.add_months("base", 36)))
    b = o.withColumn("mat", F.add_months("base", F.col("m")))
    return c.compare_pillars(a, b, ["curve_id", "tenor"]).join(a.select("curve_id", "tenor", "panel"), ["curve_id", "tenor"])


@query("c8_cut_indices", f"""WITH s AS (SELECT o_orderkey AS scenario_id, CASE WHEN o_orderkey % 5 = 0 THEN '2026-04-29, 2029-01-31' END AS named, [(o_orderkey % 8)::INT, ((o_orderkey + 3) % 8)::INT] AS idx FROM orders),
m AS (SELECT [{', '.join(f"DATE '{m}'" for m in MEETINGS)}] AS ms), x AS (SELECT scenario_id, CASE WHEN named IS NOT NULL THEN [DATE '2026-04-29', DATE '2029-01-31'] ELSE [ms[idx[1] + 1], ms[idx[2] + 1]] END AS ds FROM s, m)
SELECT scenario_id, nullif(array_to_string(list_transform(list_filter(ds, lambda v: v > DATE '{TRADE}' AND v <= DATE '{TRADE}' + 300), lambda v: strftime(v, '%Y-%m-%d')), ', '), '') AS cut_dates FROM x""")
def cut_indices(spark, d):
    k = F.col("o_orderkey")
    s = read(spark, d, "orders").select(k.alias("scenario_id"), F.when(k % 5 == 0, "2026-04-29, 2029-01-31").alias("cut_dates"), F.array((k % 8).cast("int"), ((k + 3) % 8).cast("int")).alias("cut_indices"))
    return po.with_cut_dates(s, list(MEETINGS), TRADE, 300).select("scenario_id", "cut_dates")
