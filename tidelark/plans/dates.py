"""Queries on calendars, tenors and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as t
from .tables import read

#: Years that the SQL lists; the operators know no limits.
FIRST, LAST = 1986, 2100
#: The business calendar in SQL: cal(d, is_bd, next_bd, prev_bd, mf).
CAL = f"""yy AS (SELECT unnest(range({FIRST - 1}, {LAST + 2}))::INT AS y),
fx AS (SELECT make_date(y, m, d) AS d FROM yy, (VALUES (1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) v(m, d)),
nt AS (SELECT make_date(y, m, 1) AS f, w, n FROM yy, (VALUES (1, 0, 3), (2, 0, 3), (9, 0, 1), (10, 0, 2), (11, 3, 4)) v(m, w, n)),
hol AS (SELECT CASE isodow(d) WHEN 7 THEN d + 1 WHEN 6 THEN d - 1 ELSE d END AS h FROM fx UNION SELECT f + CAST((w - (isodow(f) - 1) + 7) % 7 + 7 * (n - 1) AS INT) FROM nt
 UNION SELECT last_day(make_date(y, 5, 1)) - CAST(isodow(last_day(make_date(y, 5, 1))) - 1 AS INT) FROM yy),
c0 AS (SELECT d, isodow(d) < 6 AND d NOT IN (SELECT h FROM hol) AS is_bd FROM (SELECT CAST(unnest(generate_series(DATE '{FIRST}-01-01', DATE '{LAST}-12-31', INTERVAL 1 DAY)) AS DATE) AS d)),
c1 AS (SELECT d, is_bd, min(CASE WHEN is_bd THEN d END) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING) AS next_bd, max(CASE WHEN is_bd THEN d END) OVER (ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS prev_bd FROM c0),
cal AS (SELECT *, CASE WHEN is_bd THEN d WHEN month(next_bd) = month(d) THEN next_bd ELSE prev_bd END AS mf FROM c1)"""
Q, S = {}, {}


def query(name: str, sql: str):
    def add(f):
        Q[name] = f
        S[name] = sql
        return f

    return add


def order_dates(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


@query("t1_holidays_of_orders", f"WITH {CAL} SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT h FROM hol) GROUP BY 1")
def holidays(spark, d):
    h = t.us_holidays(spark, FIRST, LAST)
    return order_dates(spark, d).join(F.broadcast(h), F.col("d") == F.col("holiday"), "left_semi").groupBy("d").agg(F.count("*").alias("n"))


@query("t2_business_days", f"WITH {CAL} SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, next_bd, prev_bd, mf FROM orders JOIN cal ON CAST(o_orderdate AS DATE) = cal.d")
def business_days(spark, d):
    c = F.col("d")
    return order_dates(spark, d).select("o_orderkey", "d", t.next_business_day(c).alias("next_bd"), t.previous_business_day(c).alias("prev_bd"), t.modified_following(c).alias("mf"))


TENORS = ("1B", "1W", "2W", "1M", "3M", "10D", "1Y", "30Y", "xx", "95Y")


@query("t3_add_tenor", f"""WITH {CAL}, b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, ([{', '.join(repr(x) for x in TENORS)}])[1 + o_orderkey % {len(TENORS)}] AS tenor FROM orders),
r AS (SELECT *, CAST(CASE tenor WHEN '1B' THEN d WHEN '1W' THEN d + 7 WHEN '2W' THEN d + 14 WHEN '1M' THEN d + INTERVAL 1 MONTH WHEN '3M' THEN d + INTERVAL 3 MONTH WHEN '10D' THEN d + 10 WHEN '1Y' THEN d + INTERVAL 1 YEAR WHEN '30Y' THEN d + INTERVAL 30 YEAR WHEN '95Y' THEN d + INTERVAL 95 YEAR END AS DATE) AS raw FROM b)
SELECT o_orderkey, r.d, tenor, CASE tenor WHEN '1B' THEN next_bd WHEN '10D' THEN raw ELSE mf END AS matures FROM r LEFT JOIN cal ON raw = cal.d""")
def tenors(spark, d):
    names = F.array(*(F.lit(x) for x in TENORS))
    b = order_dates(spark, d).withColumn("tenor", F.get(names, (F.col("o_orderkey") % len(TENORS)).cast("int")))
    return b.select("o_orderkey", "d", "tenor", t.add_tenor(F.col("d"), F.col("tenor")).alias("matures"))


@query("t4_third_wednesdays", "SELECT o_orderkey, f + CAST((2 - (isodow(f) - 1) + 7) % 7 + 14 AS INT) AS imm, (f + CAST((2 - (isodow(f) - 1) + 7) % 7 + 14 AS INT) - CAST(o_orderdate AS DATE)) / 360.0 AS t FROM (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS f FROM orders)")
def imm(spark, d):
    o = order_dates(spark, d).withColumn("imm", t.third_wednesday(F.col("d")))
    return o.select("o_orderkey", "imm", t.act_360(F.col("d"), F.col("imm")).alias("t"))


@query("t5_futures_dates", """WITH b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, ([3, 6, 9, 12])[1 + o_orderkey % 4]::INT AS m, (o_orderkey % 10)::INT AS y FROM orders),
s AS (SELECT *, make_date((year(d) // 10 * 10 + y + 10 * k)::INT, m, 1) AS f, k FROM b, (VALUES (0), (1)) v(k)), w AS (SELECT *, f + CAST((2 - (isodow(f) - 1) + 7) % 7 + 14 AS INT) AS st, CAST(f + INTERVAL 3 MONTH AS DATE) AS g FROM s),
e AS (SELECT *, g + CAST((2 - (isodow(g) - 1) + 7) % 7 + 14 AS INT) AS en FROM w)
SELECT o_orderkey, 'SOFR3' || ([ 'H', 'M', 'U', 'Z'])[m // 3] || y AS code, st AS starts, en AS ends FROM e WHERE k = 1 OR en >= d QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY k) = 1""")
def futures(spark, d):
    letters = F.array(*(F.lit(x) for x in "HMUZ"))
    o = order_dates(spark, d).withColumn("code", F.concat(F.lit("SOFR3"), F.get(letters, (F.col("o_orderkey") % 4).cast("int")), (F.col("o_orderkey") % 10).cast("string")))
    return o.withColumn("x", t.futures_dates(F.col("code"), F.col("d"))).select("o_orderkey", "code", F.col("x.start").alias("starts"), F.col("x.end").alias("ends"))


@query("t7_annual_schedule", f"""WITH {CAL}, b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS eff, CAST(CAST(o_orderdate AS DATE) + to_months(12 * (1 + o_orderkey % 12)::INT + 5) AS DATE) AS mat FROM orders),
u AS (SELECT *, CAST(eff + to_years(n::INT) AS DATE) AS un FROM b, range(1, 20) r(n)), s AS (SELECT o_orderkey, eff, mat, n, mf FROM u JOIN cal ON cal.d = un), p AS (SELECT *, lag(mf) OVER (PARTITION BY o_orderkey ORDER BY n) AS pm FROM s)
SELECT o_orderkey, n::INT AS coupon_no, CASE WHEN mf < mat THEN mf ELSE mat END AS coupon_date FROM p WHERE n = 1 OR pm < mat""")
def annual(spark, d):
    o = order_dates(spark, d).withColumn("mat", F.add_months("d", (12 * (1 + F.col("o_orderkey") % 12) + 5).cast("int")))
    return t.annual_schedule(o, "d", "mat").select("o_orderkey", "coupon_no", "coupon_date")


@query("t7b_backward_schedule", """WITH RECURSIVE b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS settle, CAST(CAST(o_orderdate AS DATE) + to_months(7 + (o_orderkey % 60)::INT) AS DATE) AS d FROM orders),
c AS (SELECT o_orderkey, settle, d FROM b WHERE d > settle UNION ALL SELECT o_orderkey, settle, CAST(d - INTERVAL 6 MONTH AS DATE) FROM c WHERE CAST(d - INTERVAL 6 MONTH AS DATE) > settle)
SELECT o_orderkey, d AS coupon_date FROM c""")
def backward(spark, d):
    o = order_dates(spark, d).withColumn("mat", F.add_months("d", (7 + F.col("o_orderkey") % 60).cast("int")))
    return o.select("o_orderkey", F.explode(t.backward_schedule(F.col("mat"), F.col("d"))).alias("coupon_date"))
