"""Queries on panels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..operators import panel as p
from .tables import BARS_SQL, PRICES_SQL, bars, prices, read

WEEK, DAY = PRICES_SQL.format(unit="week"), PRICES_SQL.format(unit="day")
#: Log returns of the complete cases, as the operators give them.
RET = (
    WEEK
    + """, grid AS (SELECT d.date, s.symbol, price FROM (SELECT DISTINCT date FROM prices) d CROSS JOIN (SELECT DISTINCT symbol FROM prices) s LEFT JOIN prices USING (date, symbol)),
raw AS (SELECT symbol, date, ln(price) - lag(ln(price)) OVER (PARTITION BY symbol ORDER BY date) AS ret FROM grid),
rets AS (SELECT * FROM raw WHERE date IN (SELECT date FROM raw GROUP BY date HAVING count(ret) = count(*)))"""
)
Q, S = {}, {}


def query(name: str, sql: str):
    def add(f):
        Q[name] = f
        S[name] = sql
        return f

    return add


def rounded(df, digits: int = 6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("p1_contract_selection", """WITH fut AS (SELECT p_partkey, p_brand AS px_ident, CASE WHEN p_size % 3 = 0 THEN '1M' ELSE '3M' END AS maturity, p_retailprice AS price FROM part),
rules AS (SELECT 'Brand#1' AS symbol, '3M' AS m UNION ALL SELECT 'Brand#23', '1M' UNION ALL SELECT 'Brand#34', '6M'),
hit AS (SELECT f.*, symbol, px_ident = symbol AS exact FROM fut f JOIN rules ON starts_with(px_ident, symbol) AND maturity = m)
SELECT p_partkey, px_ident, maturity, price, symbol FROM hit WHERE exact OR symbol NOT IN (SELECT symbol FROM hit WHERE exact)""")
def contract_selection(spark, d):
    fut = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("px_ident"), F.when(F.col("p_size") % 3 == 0, "1M").otherwise("3M").alias("maturity"), F.col("p_retailprice").alias("price"))
    return p.select_contracts(fut, spark.createDataFrame([("Brand#1", "3M"), ("Brand#23", "1M"), ("Brand#34", "6M")], "symbol string, maturity string"))


@query("p2_default_rules", "SELECT DISTINCT p_brand AS symbol, CASE WHEN p_brand = 'Brand#11' THEN '1M' ELSE '3M' END AS maturity FROM part")
def rules(spark, d):
    return p.default_rules(read(spark, d, "part").select(F.col("p_brand").alias("px_ident")), special={"Brand#11": "1M"})


@query("p3_merge_prices", """SELECT split_part(l_returnflag || '.X', '.', 1) AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS price, l_quantity AS volume, 'Equity' AS asset_type FROM lineitem
UNION ALL SELECT o_orderpriority, CAST(o_orderdate AS DATE), o_totalprice, NULL, 'Future' FROM orders""")
def merged(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("trading_date"), F.substring_index(F.concat("l_returnflag", F.lit(".X")), ".", 1).alias("ric"), F.col("l_extendedprice").alias("last"), F.col("l_quantity").alias("volume"))
    f = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("obs_date"), F.col("o_orderpriority").alias("px_ident"), F.col("o_totalprice").alias("price"))
    return p.merge_prices(e, f)


@query("p5_range_rename", "WITH " + BARS_SQL.format(unit="day") + """ SELECT CASE symbol WHEN 'click' THEN 'CK' ELSE symbol END AS symbol, dt, close, close >= open AS up FROM bars
WHERE symbol IN ('click', 'view') AND dt >= TIMESTAMP '2024-01-05' AND dt <= TIMESTAMP '2024-01-20'""")
def range_rename(spark, d):
    b = bars(spark, d).where(F.col("symbol").isin("click", "view") & F.col("dt").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")))
    names = F.create_map(F.lit("click"), F.lit("CK"))
    return b.select(F.coalesce(names[F.col("symbol")], "symbol").alias("symbol"), "dt", "close", (F.col("close") >= F.col("open")).alias("up"))


@query("g1_pivot", "WITH " + WEEK + " SELECT date, " + ", ".join(f"max(price) FILTER (symbol = '{s}') AS \"{s}\"" for s in ("AF", "NF", "NO", "RF")) + " FROM prices WHERE symbol IN ('AF', 'NF', 'NO', 'RF') GROUP BY date")
def wide(spark, d):
    s = ["AF", "NF", "NO", "RF"]
    return p.pivot(prices(spark, d).where(F.col("symbol").isin(s)), s)


@query("g1_first_value", """SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS price FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1, 2""")
def firsts(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("price"), F.struct("l_orderkey", "l_linenumber").alias("o"))
    return p.first_values(li, "o")


@query("w1_log_returns", "WITH " + RET + " SELECT symbol, date, round(ret, 6) AS ret FROM rets")
def returns(spark, d):
    return rounded(p.log_returns(prices(spark, d)))


@query("p12_log_returns_of_some", "WITH " + DAY + """, gp AS (SELECT symbol, date, CASE WHEN symbol <> 'AF' OR day(date) % 9 <> 4 THEN price END AS price FROM prices WHERE day(date) % 10 <> 7 OR symbol = 'NO'), grid AS (SELECT d.date, s.symbol, price FROM (SELECT DISTINCT date FROM gp) d CROSS JOIN (SELECT DISTINCT symbol FROM gp) s LEFT JOIN gp USING (date, symbol)),
raw AS (SELECT symbol, date, ln(price) - lag(ln(price)) OVER (PARTITION BY symbol ORDER BY date) AS ret FROM grid) SELECT symbol, date, round(ret, 6) AS ret FROM raw WHERE date IN (SELECT date FROM raw GROUP BY date HAVING count(ret) > 0)""")
def returns_of_some(spark, d):
    g = prices(spark, d, "day").where((F.dayofmonth("date") % 10 != 7) | (F.col("symbol") == "NO"))
    return rounded(p.log_returns(g.withColumn("price", F.when((F.col("symbol") != "AF") | (F.dayofmonth("date") % 9 != 4), F.col("price"))), "all"))


@query("w3_simple_returns", "WITH " + DAY + """, grid AS (SELECT d.date, s.symbol, price FROM (SELECT DISTINCT date FROM prices) d CROSS JOIN (SELECT DISTINCT symbol FROM prices) s LEFT JOIN prices USING (date, symbol)),
f AS (SELECT symbol, date, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS q FROM grid),
r AS (SELECT symbol, date, q / lag(q) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM f)
SELECT symbol, date, round(ret, 6) AS ret FROM r WHERE ret IS NOT NULL""")
def simple(spark, d):
    return rounded(p.simple_returns(prices(spark, d, "day")))


PAIRS = ", pr AS (SELECT a.date, a.symbol AS sym_i, b.symbol AS sym_j, a.ret AS x, b.ret AS y FROM rets a JOIN rets b ON a.date = b.date AND a.symbol <= b.symbol)"


@query("w4_rolling_covariance", "WITH " + RET + PAIRS + """ SELECT date, sym_i, sym_j, round(cov, 6) AS cov, round(corr, 6) AS corr FROM (SELECT *, row_number() OVER w AS n, covar_samp(x, y) OVER v AS cov, corr(x, y) OVER v AS corr
FROM pr WINDOW w AS (PARTITION BY sym_i, sym_j ORDER BY date), v AS (PARTITION BY sym_i, sym_j ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)) WHERE n >= 126""")
def rolling_cov(spark, d):
    return rounded(p.rolling_covariance(p.log_returns(prices(spark, d))))


@query("g3_correlation", "WITH " + RET + PAIRS + " SELECT sym_i, sym_j, round(corr(x, y), 6) AS corr, count(*) AS n FROM pr GROUP BY 1, 2")
def corr(spark, d):
    return rounded(p.correlation(p.log_returns(prices(spark, d))))


#: The weights by Gauss-Jordan steps on every date's matrix with a column of ones; mat: dates with their full matrices as lists.
COVARIANCES = RET + PAIRS + """, cv AS (SELECT date, sym_i, sym_j, cov FROM (SELECT *, row_number() OVER w AS n, covar_samp(x, y) OVER v AS cov FROM pr WINDOW w AS (PARTITION BY sym_i, sym_j ORDER BY date), v AS (PARTITION BY sym_i, sym_j ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)) WHERE n >= 126)"""
WEIGHTS = """, full_ AS (SELECT date, sym_i AS i, sym_j AS j, cov FROM cv UNION ALL SELECT date, sym_j, sym_i, cov FROM cv WHERE sym_i <> sym_j), rw AS (SELECT date, i, list_append(list(cov ORDER BY j), 1.0::DOUBLE) AS row_ FROM full_ GROUP BY date, i),
mat AS (SELECT date, list(i ORDER BY i) AS syms, list(row_ ORDER BY i) AS m, 1 AS k FROM rw GROUP BY date), el AS (SELECT * FROM mat UNION ALL
 SELECT date, syms, list_transform(range(1, len(syms) + 1), lambda r: CASE WHEN r = k THEN list_transform(m[k], lambda x: x / m[k][k]) ELSE list_transform(range(1, len(syms) + 2), lambda c: m[r][c] - m[r][k] * m[k][c] / m[k][k]) END), k + 1 FROM el WHERE k <= len(syms)),
solved AS (SELECT date, syms, list_transform(m, lambda r: r[-1]) AS x FROM el WHERE k = len(syms) + 1), wt AS (SELECT date, unnest(syms) AS symbol, unnest(list_transform(x, lambda v: v / list_sum(x))) AS weight FROM solved)"""
CONTRIBUTIONS = WEIGHTS + """, cw AS (SELECT f.date, f.i AS symbol, sum(f.cov * w.weight) AS cw, sqrt(max(CASE WHEN f.i = f.j THEN f.cov END)) AS vol FROM full_ f JOIN wt w ON w.date = f.date AND w.symbol = f.j GROUP BY f.date, f.i),
rc AS (SELECT date, symbol, weight, vol, cw, sqrt(sum(weight * cw) OVER (PARTITION BY date)) AS total FROM cw JOIN wt USING (date, symbol))"""


def weights_of(spark, d):
    cov = p.rolling_covariance(p.log_returns(prices(spark, d)))
    return cov, p.min_variance_weights(cov)


@query("g6_min_variance", "WITH RECURSIVE " + COVARIANCES + WEIGHTS + " SELECT date, symbol, round(weight, 6) AS weight FROM wt")
def min_variance(spark, d):
    return rounded(weights_of(spark, d)[1])


@query("g7_risk_contributions", "WITH RECURSIVE " + COVARIANCES + CONTRIBUTIONS + """ SELECT date, symbol, round(weight, 6) AS weight, round(vol, 6) AS vol, round(cw / (vol * total), 6) AS corr_pfl, round(weight * vol, 6) AS stand_alone, round(cw / total, 6) AS marginal, round(weight * cw / total, 6) AS contribution, round(total, 6) AS total FROM rc""")
def risk(spark, d):
    return rounded(p.risk_contributions(*weights_of(spark, d)))


@query("g5_portfolio_std", "WITH " + RET + """, w AS (SELECT symbol, row_number() OVER (ORDER BY symbol) / 21.0 AS w FROM (SELECT DISTINCT symbol FROM rets)), pf AS (SELECT date, sum(ret * w) AS r FROM rets JOIN w USING (symbol) GROUP BY date)
SELECT round(stddev_samp(r), 6) AS std, count(*) AS n FROM pf""")
def portfolio_std(spark, d):
    r = p.log_returns(prices(spark, d))
    w = r.select("symbol").distinct().withColumn("w", F.row_number().over(p.Window.orderBy("symbol")) / 21.0)  # the symbols alone go to one task
    pf = r.join(w, "symbol").groupBy("date").agg(F.sum(F.col("ret") * F.col("w")).alias("r"))
    return rounded(pf.agg(F.stddev_samp("r").alias("std"), F.count("*").alias("n")))


@query("g8_size_contracts", """WITH b AS (SELECT p_brand AS book, p_partkey AS symbol, p_size / 50.0 AS weight, p_retailprice * 10 AS unit_value FROM part),
c AS (SELECT *, CAST(trunc(round_even(weight * 1000000.0 / unit_value, 1)) AS INT) AS contracts FROM b)
SELECT book, symbol, weight, unit_value, contracts, contracts * unit_value AS exposure, round(contracts * unit_value / sum(contracts * unit_value) OVER (PARTITION BY book), 6) AS share FROM c""")
def sizing(spark, d):
    b = read(spark, d, "part").select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("symbol"), (F.col("p_size") / 50.0).alias("weight"), (F.col("p_retailprice") * 10).alias("unit_value"))
    return p.size_contracts(b, 1_000_000.0).withColumn("share", F.round("share", 6))


#: Two series of a study: slope of the long over the short symbol, and a proxy.
STUDY = WEEK + """, j AS (SELECT a.date, (b.price - a.price) * 10 AS s, a.price + 4 * c.price AS q FROM prices a JOIN prices b ON a.date = b.date AND b.symbol = 'RF' JOIN prices c ON c.date = a.date AND c.symbol = 'NO' WHERE a.symbol = 'AF'),
k AS (SELECT date, CASE WHEN date <= DATE '1994-06-30' THEN s + 48.56 ELSE s END AS s, q FROM j),
df AS (SELECT date, s - lag(s) OVER (ORDER BY date) AS ds, q - lag(q) OVER (ORDER BY date) AS dq FROM k),
st AS (SELECT 1 AS study, date, greatest(-210.0, least(210.0, ds)) AS x, greatest(-300.0, least(300.0, dq)) AS y FROM df WHERE ds IS NOT NULL AND dq IS NOT NULL),
rg AS (SELECT *, CASE WHEN x > 1.5 THEN 'Steepening' WHEN x < -1.5 THEN 'Flattening' ELSE 'Stable' END AS regime FROM st)"""


def study(spark, d):
    """(study, date, x, y, regime): clipped changes of a slope and its proxy, after a structural break is taken out."""
    w = prices(spark, d)
    s = lambda name, col: w.where(F.col("symbol") == name).select("date", F.col("price").alias(col))
    j = s("AF", "a").join(s("RF", "b"), "date").join(s("NO", "c"), "date")
    j = j.select(F.lit(1).alias("study"), "date", ((F.col("b") - F.col("a")) * 10).alias("s"), (F.col("a") + 4 * F.col("c")).alias("q"))
    j = j.withColumn("s", F.when(F.col("date") <= F.lit("1994-06-30").cast("date"), F.col("s") + 48.56).otherwise(F.col("s")))
    over = p.Window.partitionBy("study").orderBy("date")
    j = j.select("study", "date", (F.col("s") - F.lag("s").over(over)).alias("ds"), (F.col("q") - F.lag("q").over(over)).alias("dq")).dropna()
    return j.select("study", "date", p.clip(F.col("ds"), -210.0, 210.0).alias("x"), p.clip(F.col("dq"), -300.0, 300.0).alias("y")).withColumn("regime", p.regime(F.col("x")))


@query("p8_slope_changes", "WITH " + STUDY + " SELECT study, date, round(x, 6) AS x, round(y, 6) AS y, regime FROM rg")
def slope_changes(spark, d):
    return rounded(study(spark, d))


OLS = """round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, regr_count(y, x) AS n, round(sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 6) AS slope_se,
round(regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 4) AS t, round(1 - (1 - regr_r2(y, x)) * (count(*) - 1) / (count(*) - 2), 6) AS adj_r2"""


def _ols(df, by):
    return p.regression(df, "y", "x", by).select(*by, *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")), "n", F.round("slope_se", 6).alias("slope_se"), F.round("t", 4).alias("t"), F.round("adj_r2", 6).alias("adj_r2"))


#: The tails of t by Simpson's rule over its density.
P_VALUE = "round(1 - 2 * exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi()) * (abs(tt) / 6000) * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * (1 + (abs(tt) * i / 2000.0::DOUBLE) ** 2 / nu) ** (-(nu + 1) / 2))), 6)"


@query("g10_regression", "WITH " + STUDY + f", fit AS (SELECT study, {OLS}, (count(*) - 2)::DOUBLE AS nu, regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS tt FROM rg GROUP BY study) SELECT * EXCLUDE (nu, tt), round(tt * tt, 3) AS f, {P_VALUE} AS p_t, {P_VALUE} AS p_f FROM fit")
def ols(spark, d):
    r = p.regression(study(spark, d), "y", "x", ["study"])
    return _ols(study(spark, d), ["study"]).join(r.select("study", F.round("f", 3).alias("f"), F.round("p_t", 6).alias("p_t"), F.round("p_f", 6).alias("p_f")), "study")


@query("g11_regime_regression", "WITH " + STUDY + f" SELECT regime, {OLS} FROM rg GROUP BY regime HAVING count(*) > 2")
def regime_ols(spark, d):
    return _ols(study(spark, d), ["regime"]).where("n > 2")


@query("g10_durbin_watson", "WITH " + STUDY + """, f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM rg), e AS (SELECT date, study, y - a - b * x AS e FROM rg, f), l AS (SELECT study, e, e - lag(e) OVER (ORDER BY date) AS dd FROM e)
SELECT study, round(sum(dd * dd) / sum(e * e), 6) AS dw FROM l GROUP BY study""")
def dw(spark, d):
    return rounded(p.durbin_watson(study(spark, d), "y", "x", ["study"]))


@query("w5_rolling_slope", "WITH " + STUDY + """ SELECT date, round(CASE WHEN count(*) OVER v = 64 THEN regr_slope(y, x) OVER v END, 6) AS beta FROM rg WINDOW v AS (PARTITION BY study ORDER BY date ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)""")
def rolling_beta(spark, d):
    return rounded(p.rolling_slope(study(spark, d), "y", "x", ["study"]).select("date", "beta"))


@query("w6_regime_rolling_slope", "WITH " + STUDY + """ SELECT date, regime, round(CASE WHEN count(*) OVER v = 64 THEN regr_slope(y, x) OVER v END, 6) AS beta FROM rg WINDOW v AS (PARTITION BY study, regime ORDER BY date ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)""")
def regime_beta(spark, d):
    return rounded(p.rolling_slope(study(spark, d), "y", "x", ["study", "regime"]).select("date", "regime", "beta"))


@query("g12_box_stats", "WITH " + STUDY + """, q AS (SELECT regime, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3 FROM rg GROUP BY regime)
SELECT regime, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(y) FILTER (y >= q1 - 1.5 * (q3 - q1) AND y <= q3 + 1.5 * (q3 - q1)), 6) AS low, round(max(y) FILTER (y >= q1 - 1.5 * (q3 - q1) AND y <= q3 + 1.5 * (q3 - q1)), 6) AS high,
count(*) FILTER (NOT (y >= q1 - 1.5 * (q3 - q1) AND y <= q3 + 1.5 * (q3 - q1))) AS outliers FROM rg JOIN q USING (regime) GROUP BY regime, q1, median, q3""")
def boxes(spark, d):
    return rounded(p.box_stats(study(spark, d), "y", ["regime"]))


#: Studies of all ordered triples of symbols, on daily prices with gaps.
STUDIES = DAY + """, gp AS (SELECT symbol, date, CASE WHEN day(date) % 11 <> 3 THEN price END AS price FROM prices), sy AS (SELECT DISTINCT symbol FROM prices), sd AS (SELECT (a.symbol || b.symbol || c.symbol) AS study_id, a.symbol AS near, b.symbol AS far, c.symbol AS proxy_a, a.symbol AS proxy_b FROM sy a, sy b, sy c WHERE a.symbol <> b.symbol AND b.symbol <> c.symbol AND a.symbol <> c.symbol),
lg AS (SELECT study_id, leg, symbol FROM sd UNPIVOT (symbol FOR leg IN (near, far, proxy_a, proxy_b))), rw AS (SELECT study_id, leg, date, price FROM lg JOIN gp USING (symbol) QUALIFY count(*) OVER (PARTITION BY study_id, date) = 4),
kn AS (SELECT *, last_value(CASE WHEN price IS NOT NULL THEN date END IGNORE NULLS) OVER u AS d0, last_value(price IGNORE NULLS) OVER u AS p0, first_value(CASE WHEN price IS NOT NULL THEN date END IGNORE NULLS) OVER v AS d1, first_value(price IGNORE NULLS) OVER v AS p1 FROM rw
WINDOW u AS (PARTITION BY study_id, leg ORDER BY date ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY study_id, leg ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS (SELECT study_id, leg, date, coalesce(price, CASE WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN p0 + (p1 - p0) * (date - d0) / (d1 - d0) END, p0) AS price FROM kn),
pv AS (SELECT study_id, date, max(price) FILTER (leg = 'near') AS n, max(price) FILTER (leg = 'far') AS f, max(price) FILTER (leg = 'proxy_a') AS a, max(price) FILTER (leg = 'proxy_b') AS b FROM fl GROUP BY 1, 2),
ch AS (SELECT study_id, date, (f - n) * 10 - lag((f - n) * 10) OVER w AS dx, pq - lag(pq) OVER w AS dy FROM (SELECT *, a + 4 * b + CASE WHEN date <= DATE '1994-06-30' THEN 48.56::DOUBLE ELSE 0 END AS pq FROM pv) q WINDOW w AS (PARTITION BY study_id ORDER BY date)),
cl AS (SELECT study_id, date, greatest(-2100.0::DOUBLE, least(2100.0::DOUBLE, dx)) AS x, greatest(-300.0::DOUBLE, least(300.0::DOUBLE, dy)) AS y FROM ch WHERE dx IS NOT NULL AND dy IS NOT NULL), rg AS (SELECT *, CASE WHEN x > 15 THEN 'Steepening' WHEN x < -15 THEN 'Flattening' ELSE 'Stable' END AS regime FROM cl),
ev AS (SELECT study_id, 'All' AS regime, date, x, y FROM rg UNION ALL SELECT study_id, regime, date, x, y FROM rg), bt AS (SELECT study_id, regime, arg_max(b, date) AS beta FROM (SELECT study_id, regime, date, CASE WHEN count(*) OVER v = 64 THEN regr_slope(y, x) OVER v END AS b FROM ev WINDOW v AS (PARTITION BY study_id, regime ORDER BY date ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)) q WHERE b IS NOT NULL GROUP BY 1, 2)"""


@query("c15_slope_studies", "WITH " + STUDIES + """ SELECT study_id, regime, count(*) AS n, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 5) AS r2, round(any_value(beta), 5) AS beta FROM ev LEFT JOIN bt USING (study_id, regime) GROUP BY study_id, regime""")
def studies(spark, d):
    """All ordered triples of the symbols: slope of the second over the first, and the third plus four times the first as its proxy."""
    prices_ = prices(spark, d, "day")
    s = prices_.select("symbol").distinct()
    a, b, c = (s.select(F.col("symbol").alias(n)) for n in ("near", "far", "proxy_a"))
    t = a.join(b, F.col("near") != F.col("far")).join(c, (F.col("proxy_a") != F.col("near")) & (F.col("proxy_a") != F.col("far")))  # the symbols of a panel
    t = t.select(F.concat("near", "far", "proxy_a").alias("study_id"), "*", F.col("near").alias("proxy_b"), F.lit(10.0).alias("scale"), F.lit(4.0).alias("weight"), F.to_date(F.lit("1994-06-30")).alias("break_date"), F.lit(48.56).alias("break_shift"), F.lit(2100.0).alias("clip_x"), F.lit(300.0).alias("clip_y"), F.lit(15.0).alias("band"))
    x = p.slope_studies(prices_.withColumn("price", F.when(F.dayofmonth("date") % 11 != 3, F.col("price"))), t)
    return p.study_results(x).select("study_id", "regime", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 5).alias("r2"), F.round("beta", 5).alias("beta"))


@query("w7_historical_volatility", "WITH " + WEEK + """, r AS (SELECT symbol, date, ln(price) - lag(ln(price)) OVER (PARTITION BY symbol ORDER BY date) AS ret FROM prices WHERE price IS NOT NULL)
SELECT symbol, date, round(CASE WHEN count(ret) OVER v = 252 THEN stddev_samp(ret) OVER v * sqrt(252.0) END, 6) AS vol FROM r WHERE ret IS NOT NULL WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
def hist_vol(spark, d):
    return rounded(p.historical_volatility(prices(spark, d), 252))


@query("w8_ewma_volatility", "WITH RECURSIVE " + WEEK + """, r AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, ret FROM (SELECT symbol, date, ln(price) - lag(ln(price)) OVER (PARTITION BY symbol ORDER BY date) AS ret FROM prices) WHERE ret IS NOT NULL),
f AS (SELECT symbol, date, i, 1.0::DOUBLE AS w, 1.0::DOUBLE AS w2, ret AS m, 0.0::DOUBLE AS v FROM r WHERE i = 1
UNION ALL SELECT r.symbol, r.date, r.i, f.w * (1 - 2 / 64.0::DOUBLE) + 1, f.w2 * (1 - 2 / 64.0::DOUBLE) ** 2 + 1, f.m + (ret - f.m) / (f.w * (1 - 2 / 64.0::DOUBLE) + 1),
 (f.w * (1 - 2 / 64.0::DOUBLE) * f.v + (ret - f.m) * (ret - (f.m + (ret - f.m) / (f.w * (1 - 2 / 64.0::DOUBLE) + 1)))) / (f.w * (1 - 2 / 64.0::DOUBLE) + 1) FROM f JOIN r ON r.symbol = f.symbol AND r.i = f.i + 1)
SELECT symbol, date, round(CASE WHEN i > 1 THEN sqrt(v * w * w / (w * w - w2) * 252) END, 6) AS vol FROM f""")
def ewma(spark, d):
    return rounded(p.ewma_volatility(prices(spark, d)))


@query("w9_interpolation", "WITH " + DAY + """, grid AS (SELECT d.date, s.symbol, CASE WHEN day(d.date) % 7 = 0 THEN NULL ELSE price END AS price FROM (SELECT DISTINCT date FROM prices) d CROSS JOIN (SELECT DISTINCT symbol FROM prices) s LEFT JOIN prices USING (date, symbol)),
b AS (SELECT *, last_value(CASE WHEN price IS NOT NULL THEN date END IGNORE NULLS) OVER u AS d0, last_value(price IGNORE NULLS) OVER u AS p0, first_value(CASE WHEN price IS NOT NULL THEN date END IGNORE NULLS) OVER v AS d1, first_value(price IGNORE NULLS) OVER v AS p1 FROM grid
WINDOW u AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, date, round(coalesce(price, CASE WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN p0 + (p1 - p0) * (date - d0) / (d1 - d0) END, p0) + 1e-9, 6) AS price FROM b""")
def interpolation(spark, d):
    g = p.spine(prices(spark, d, "day")).withColumn("price", F.when(F.dayofmonth("date") % 7 != 0, F.col("price")))
    return rounded(p.interpolate_in_time(g, "price").select("symbol", "date", (F.col("price") + 1e-9).alias("price")))


@query("w10_index", "WITH " + WEEK + """ SELECT symbol, date, price, round(100 * price / first_value(price) OVER (PARTITION BY symbol ORDER BY date), 6) AS idx FROM prices WHERE date BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'""")
def index(spark, d):
    return rounded(p.index_to_100(prices(spark, d), "1993-01-01", "1996-12-31"))


@query("w12_position_pnl", "WITH " + WEEK + """, x AS (SELECT symbol, date, price * 3 * 50.0 AS v FROM prices), y AS (SELECT symbol, date, v - coalesce(lag(v) OVER (PARTITION BY symbol ORDER BY date), 140000.0) AS pnl FROM x)
SELECT symbol, date, round(pnl, 6) AS pnl, round(pnl / 10000000.0, 6) AS ret, round(grown, 6) AS grown, round_even(100 * (grown - 1), 2) AS cum_pct FROM (SELECT *, product(1 + pnl / 10000000.0) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS grown FROM y)""")
def pnl(spark, d):
    names = [(s, 3, 50.0, 140000.0) for s in ("AF", "NF", "NO", "RF", "AO", "RO")]
    out = p.position_pnl(prices(spark, d), spark.createDataFrame(names, "symbol string, contracts int, multiplier double, initial_value double"), 10_000_000.0)
    return rounded(out)


@query("g23_extent", "WITH " + BARS_SQL.format(unit="hour") + """ SELECT symbol, round(min(low) - (max(high) - min(low)) * 0.05, 6) AS low, round(max(high) + (max(high) - min(low)) * 0.05, 6) AS high FROM bars WHERE dt BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-12' GROUP BY symbol""")
def extents(spark, d):
    return rounded(p.extent(bars(spark, d, "hour").withColumn("dt", F.col("dt").cast("timestamp_ntz")), "2024-01-03", "2024-01-12"))


@query("o3_last_bars", "WITH " + BARS_SQL.format(unit="day") + " SELECT symbol, dt, open, high, low, close, volume FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) <= 3")
def last_bars(spark, d):
    w = p.Window.partitionBy("symbol").orderBy(F.desc("dt"))
    return bars(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 3").drop("n")


@query("c14_gmv_workflow", "WITH RECURSIVE " + COVARIANCES.replace(") WHERE n >= 126)", ") WHERE n = 126 AND date = (SELECT min(date) FROM (SELECT date, row_number() OVER (PARTITION BY sym_i, sym_j ORDER BY date) AS n FROM pr) WHERE n >= 126))") + CONTRIBUTIONS + """,
sz AS (SELECT symbol, weight, weight * cw / total AS contribution, total, vol, cw, floor(price * 4 + 0.5) / 4 * 50.0 AS unit_value, CAST(trunc(round_even(weight * 1000000000.0 / (floor(price * 4 + 0.5) / 4 * 50.0), 1)) AS INT) AS contracts FROM rc JOIN prices USING (symbol, date)), sh AS (SELECT *, contracts * unit_value AS v0, contracts * unit_value / sum(contracts * unit_value) OVER () AS share FROM sz),
hr AS (SELECT symbol, date FROM (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM rets) WHERE n BETWEEN 127 AND 189), hv AS (SELECT symbol, date, price * contracts * 50.0 AS v, v0 FROM hr JOIN prices USING (symbol, date) JOIN sh USING (symbol)),
hp AS (SELECT symbol, date, v - coalesce(lag(v) OVER (PARTITION BY symbol ORDER BY date), v0) AS pnl FROM hv), sd AS (SELECT stddev_samp(r) AS std_after FROM (SELECT date, sum(ret * share) AS r FROM rets JOIN hr USING (symbol, date) JOIN sh USING (symbol) GROUP BY date) q),
he AS (SELECT symbol, sum(pnl) AS pnl, round_even(100 * (product(1 + pnl / 1000000000.0) - 1), 2) AS cum_pct, count(*) AS n FROM hp GROUP BY symbol)
SELECT symbol, round(weight, 6) AS weight, round(contribution, 6) AS contribution, round(total, 6) AS total, contracts, round(share, 6) AS share, round(pnl, 6) AS pnl, round(cum_pct, 6) AS cum_pct, n, round(share * vol, 6) AS xs, round(share * cw / total, 6) AS xsr, round(std_after, 6) AS std_after FROM sh JOIN he USING (symbol), sd""")
def gmv_workflow(spark, d):
    """From prices to contracts of least variance at the first rolling date, valued over the 63 rows after the first 126."""
    rets = p.log_returns(prices(spark, d))
    cov = p.rolling_covariance(rets)
    first = cov.agg(F.min("date").alias("date"))
    cov = cov.join(F.broadcast(first), "date", "left_semi")
    w = p.min_variance_weights(cov)
    last = prices(spark, d).join(F.broadcast(first), "date", "left_semi").select("symbol", F.col("price").alias("p0"))
    pos = p.size_contracts(p.risk_contributions(cov, w).join(last, "symbol").withColumn("unit_value", nm.tick_round(F.col("p0"), F.lit(0.25)) * 50.0), 1_000_000_000.0)
    pos = pos.withColumns({"xs": F.col("share") * F.col("vol"), "xsr": F.col("share") * F.col("marginal")})
    rows = rets.withColumn("n", F.row_number().over(p._by("symbol"))).where("n BETWEEN 127 AND 189").select("symbol", "date", "ret")
    held = pos.select("symbol", "contracts", F.lit(50.0).alias("multiplier"), (F.col("contracts") * F.col("unit_value")).alias("initial_value"))
    pnl = p.position_pnl(prices(spark, d).join(rows.drop("ret"), ["symbol", "date"]), held, 1_000_000_000.0)
    ends = pnl.groupBy("symbol").agg(F.sum("pnl").alias("pnl"), F.max_by("cum_pct", "date").alias("cum_pct"), F.count("*").alias("n"))
    after = rows.join(pos.select("symbol", "share"), "symbol").groupBy("date").agg(F.sum(F.col("ret") * F.col("share")).alias("r"))
    out = pos.select("symbol", "weight", "contribution", "total", "contracts", "share", "xs", "xsr").join(ends, "symbol")
    return rounded(out.join(F.broadcast(after.agg(F.stddev_samp("r").alias("std_after")))))  # one row

