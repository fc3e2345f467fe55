"""Queries on options, ticks and books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..operators import portfolio as o
from .panel import rounded
from .tables import read

AS_OF = "2026-02-23"
Q, S = {}, {}


def query(name: str, sql: str):
    def add(f):
        Q[name] = f
        S[name] = sql
        return f

    return add


def _horner(c, x):
    return "(" * (len(c) - 1) + f"{c[0]}::DOUBLE" + "".join(f" * {x} + {k}::DOUBLE)" for k in c[1:])


def cdf(x: str) -> str:
    """The normal distribution as an SQL expression, of a plain name."""
    a = f"abs({x})"
    e = f"exp(-({a} * {a}) / 2)"
    tail = f"({a} + 1.0::DOUBLE / ({a} + 2.0::DOUBLE / ({a} + 3.0::DOUBLE / ({a} + 4.0::DOUBLE / ({a} + 0.65::DOUBLE)))))"
    c = f"(CASE WHEN {a} > 37 THEN 0.0::DOUBLE WHEN {a} < 7.07106781186547::DOUBLE THEN {e} * {_horner(nm.CDF_P, a)} / {_horner(nm.CDF_Q, a)} ELSE {e} / {tail} / 2.506628274631::DOUBLE END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {c} ELSE {c} END)"


#: Books from lineitem and part: one book an order key modulo 997. Options on futures are priced on the contract of the brand, or on themselves.
POS = """pos AS (SELECT l_orderkey % 997 AS book_id, (l_orderkey * 10 + l_linenumber)::BIGINT AS pos_no, CASE WHEN l_orderkey % 13 = 0 THEN 'swap' ELSE ([ 'equity', 'future', 'option'])[1 + l_linenumber % 3] END AS type,
 CASE l_linenumber % 3 WHEN 0 THEN 'E' || l_partkey WHEN 1 THEN p_brand || 'H26' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'O' || l_partkey ELSE p_brand || 'X26' END END AS symbol, CASE l_returnflag WHEN 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
 CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice / l_quantity END AS trade_price, floor(p_retailprice / 10) * 10 + (l_orderkey % 5 - 2) * 25 AS strike,
 CASE WHEN l_orderkey % 7 = 0 THEN DATE '2026-02-23' + (l_orderkey % 400 - 20)::INT END AS expiry, CASE WHEN l_orderkey % 4 <> 0 THEN (l_orderkey % 365)::INT END AS expiry_days, CASE l_linestatus WHEN 'O' THEN 'call' ELSE 'put' END AS option_type,
 CASE WHEN l_linenumber % 3 = 2 THEN CASE WHEN l_partkey % 2 = 1 THEN 'future' WHEN l_partkey % 4 = 0 THEN 'equity' END END AS underlying_type, CASE WHEN l_linenumber % 3 = 2 THEN CASE WHEN l_partkey % 2 = 0 THEN 'E' || l_partkey WHEN l_partkey % 5 <> 0 THEN p_brand || 'H26' END END AS underlying_symbol,
 CASE WHEN l_partkey % 3 <> 0 THEN (l_partkey % 3) / 100.0::DOUBLE END AS q, CASE WHEN l_partkey % 10 < 8 THEN 0.05::DOUBLE + l_discount END AS vol, CASE WHEN l_orderkey % 3 <> 0 THEN l_tax END AS rate, CASE WHEN l_orderkey % 9 <> 0 THEN l_orderkey % 11 <> 0 END AS open
 FROM lineitem JOIN part ON l_partkey = p_partkey),
brands AS (SELECT p_brand AS b, right(p_brand, 1) AS d, max(p_size) AS s, max(p_retailprice) AS px FROM part GROUP BY p_brand),
marks AS (SELECT 'E' || p_partkey AS symbol, p_retailprice AS price FROM part WHERE p_partkey % 17 <> 0 UNION ALL SELECT b || 'H26', px FROM brands UNION ALL SELECT b || 'X26', px * 0.9::DOUBLE FROM brands WHERE d = '2'),
vols AS (SELECT 'E' || p_partkey AS symbol, p_size / 100.0::DOUBLE AS vol FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'O' || p_partkey, p_size / 150.0::DOUBLE FROM part WHERE p_size % 3 = 0 UNION ALL SELECT b || 'H26', 0.3::DOUBLE FROM brands WHERE d IN ('1', '2') UNION ALL SELECT b || 'X26', 0.25::DOUBLE FROM brands WHERE d = '1'),
specs AS (SELECT b AS symbol, s::DOUBLE AS multiplier, 0.25::DOUBLE AS tick_size, CASE d WHEN '4' THEN '' WHEN '3' THEN NULL ELSE 'Class' || d END AS asset_class FROM brands WHERE d <> '5' UNION ALL SELECT b || 'H26', 50.0::DOUBLE, 0.5::DOUBLE, 'Contract' FROM brands),
omarks AS (SELECT 'E' || p_partkey || '_MAR26_' || (floor(p_retailprice / 10) * 10)::INT || 'C' AS okey, (CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size END)::DOUBLE AS mark FROM part)"""


def positions(spark, d):
    li = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k, n, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    named = lambda letter: F.concat(F.lit(letter), part.cast("string"))
    option = n % 3 == 2
    return li.select(
        (k % 997).alias("book_id"), (k * 10 + n).alias("pos_no"), F.when(k % 13 == 0, "swap").otherwise(F.get(F.array(F.lit("equity"), F.lit("future"), F.lit("option")), n % 3)).alias("type"),
        F.when(n % 3 == 0, named("E")).when(n % 3 == 1, F.concat("p_brand", F.lit("H26"))).when(part % 2 == 0, named("O")).otherwise(F.concat("p_brand", F.lit("X26"))).alias("symbol"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(k % 5 != 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("trade_price"), (F.floor(F.col("p_retailprice") / 10) * 10 + (k % 5 - 2) * 25).cast("double").alias("strike"),
        F.when(k % 7 == 0, F.date_add(F.to_date(F.lit(AS_OF)), (k % 400 - 20).cast("int"))).alias("expiry"), F.when(k % 4 != 0, (k % 365).cast("int")).alias("expiry_days"), F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("option_type"),
        F.when(option & (part % 2 == 1), "future").when(option & (part % 4 == 0), "equity").alias("underlying_type"), F.when(option & (part % 2 == 0), named("E")).when(option & (part % 5 != 0), F.concat("p_brand", F.lit("H26"))).alias("underlying_symbol"),
        F.when(part % 3 != 0, (part % 3) / 100).alias("q"), F.when(part % 10 < 8, F.lit(0.05) + F.col("l_discount")).alias("vol"), F.when(k % 3 != 0, F.col("l_tax")).alias("rate"), F.when(k % 9 != 0, k % 11 != 0).alias("open"),
    )


def dimensions(spark, d):
    """marks, volatilities, specs and marks of options."""
    part = read(spark, d, "part")
    brand = part.groupBy(F.col("p_brand").alias("b"), F.substring("p_brand", -1, 1).alias("d")).agg(F.max("p_size").alias("s"), F.max("p_retailprice").alias("px"))
    named = lambda letter: F.concat(F.lit(letter), F.col("p_partkey").cast("string")).alias("symbol")
    contract = lambda month: F.concat("b", F.lit(month)).alias("symbol")
    marks = part.where("p_partkey % 17 <> 0").select(named("E"), F.col("p_retailprice").alias("price")).unionAll(brand.select(contract("H26"), "px")).unionAll(brand.where("d = '2'").select(contract("X26"), F.col("px") * 0.9))
    vols = part.where("p_size % 2 = 0").select(named("E"), (F.col("p_size") / 100).alias("vol")).unionAll(part.where("p_size % 3 = 0").select(named("O"), F.col("p_size") / 150))
    vols = vols.unionAll(brand.where("d IN ('1', '2')").select(contract("H26"), F.lit(0.3))).unionAll(brand.where("d = '1'").select(contract("X26"), F.lit(0.25)))
    group = F.when(F.col("d") == "4", "").when(F.col("d") != "3", F.concat(F.lit("Class"), "d"))
    specs = brand.where("d <> '5'").select(F.col("b").alias("symbol"), F.col("s").cast("double").alias("multiplier"), F.lit(0.25).alias("tick_size"), group.alias("asset_class"))
    specs = specs.unionAll(brand.select(contract("H26"), F.lit(50.0), F.lit(0.5), F.lit("Contract")))
    strike = (F.floor(F.col("p_retailprice") / 10) * 10).cast("int").cast("string")
    option_marks = part.select(F.concat(F.lit("E"), F.col("p_partkey").cast("string"), F.lit("_MAR26_"), strike, F.lit("C")).alias("option_key"), F.when(F.col("p_size") % 10 != 0, F.col("p_size")).otherwise(0).cast("double").alias("unit_price"))
    return marks, vols, specs, option_marks


def resolved(spark, d):
    return o.resolve(positions(spark, d), *dimensions(spark, d), as_of=AS_OF)


YEARS = lambda *days: f"greatest(coalesce({', '.join(days)}, 30) / 365.0::DOUBLE, 1e-6)"
RESOLVED = POS + f""", r0 AS (SELECT pos.*, coalesce(underlying_symbol, symbol) AS und, type = 'option' AND underlying_type IS NOT DISTINCT FROM 'future' AS fwd FROM pos WHERE coalesce(open, TRUE) AND type IN ('equity', 'future', 'option')),
rs AS (SELECT r0.*, coalesce(mu.price, mo.price) AS price_risk, CASE WHEN type = 'option' THEN coalesce(mu.price, mo.price) ELSE mo.price END AS price_mtm, coalesce(vo.vol, r0.vol, 0.2) AS vol_mtm, coalesce(vo.vol, vu.vol, r0.vol, 0.2) AS vol_risk, CASE WHEN type = 'option' THEN coalesce(vo.vol, vu.vol) ELSE vo.vol END AS vol_day,
 CASE WHEN type = 'equity' OR underlying_type IS NOT DISTINCT FROM 'equity' THEN 'Equity' WHEN sc.asset_class = '' THEN 'DerivUnknown' ELSE coalesce(sc.asset_class, 'Unknown') END AS asset_class,
 CASE WHEN fwd THEN coalesce(su.multiplier, 1) WHEN type = 'option' THEN 100 WHEN type = 'future' THEN coalesce(so.multiplier, 1) ELSE 1 END::DOUBLE AS multiplier, CASE WHEN fwd OR type = 'future' THEN coalesce(su.multiplier, 1) WHEN type = 'option' THEN 100 ELSE 1 END::DOUBLE AS mult_risk,
 CASE WHEN fwd THEN sr.tick_size WHEN type = 'option' THEN 0.01 END AS model_tick, CASE WHEN fwd OR type = 'future' THEN coalesce(su.tick_size, 0.01) ELSE 0.01 END AS risk_tick,
 {YEARS("expiry - DATE '2026-02-23'", "expiry_days")} AS t_mtm, {YEARS("expiry_days", "greatest(expiry - DATE '2026-02-23', 0)")} AS t_risk, CASE WHEN fwd THEN 0.04 ELSE coalesce(rate, 0.04) END AS rate_mtm, 0.04::DOUBLE AS rate_risk, coalesce(q, 0) AS carry, option_type = 'call' AS call,
 CASE WHEN type = 'option' THEN und || '_' || upper(strftime(coalesce(expiry, DATE '2026-02-23' + expiry_days), '%b%y')) || '_' || strike::BIGINT || CASE option_type WHEN 'call' THEN 'C' ELSE 'P' END END AS okey
 FROM r0 LEFT JOIN marks mu ON mu.symbol = und LEFT JOIN marks mo ON mo.symbol = r0.symbol LEFT JOIN vols vu ON vu.symbol = und LEFT JOIN vols vo ON vo.symbol = r0.symbol LEFT JOIN specs su ON su.symbol = und LEFT JOIN specs so ON so.symbol = r0.symbol
 LEFT JOIN specs sr ON sr.symbol = left(und, greatest(0, length(und) - 3)) LEFT JOIN specs sc ON sc.symbol = left(r0.symbol, greatest(0, length(r0.symbol) - 3)))"""


def pricing(t: str, r: str, v: str, price: str, source: str = "rs") -> str:
    """Prices and Greeks of the options of a source, by the names of their time, rate, volatility and price."""
    return f"""d0 AS (SELECT *, {price} AS price, {t} AS t, {r} AS r, {v} AS v, CASE WHEN fwd THEN 0 ELSE {r} - carry END AS b, CASE WHEN call THEN 1.0 ELSE -1.0 END::DOUBLE AS w FROM {source}),
d1 AS (SELECT *, (ln(price / strike) + (b + v * v / 2) * t) / (v * sqrt(t)) AS a, exp((b - r) * t) AS grow, exp(-r * t) AS dr FROM d0), d3 AS (SELECT *, w * a AS wa, w * (a - v * sqrt(t)) AS wb FROM d1),
d4 AS (SELECT *, {cdf('wa')} AS na, {cdf('wb')} AS nb, exp(-a * a / 2) / 2.5066282746310002::DOUBLE AS pdf FROM d3), d5 AS (SELECT *, w * (price * grow * na - strike * dr * nb) AS oprice FROM d4),
op AS (SELECT *, w * grow * na AS delta, grow * pdf / (price * v * sqrt(t)) AS gamma, price * grow * pdf * sqrt(t) AS vega, -price * grow * pdf * v / (2 * sqrt(t)) + CASE WHEN fwd THEN r * oprice ELSE -carry * price * grow * na - r * w * strike * dr * nb END AS theta,
 CASE WHEN fwd THEN -t * oprice ELSE w * strike * t * dr * nb END AS rho FROM d5)"""


@query("t8_tick_round", "SELECT l_orderkey, l_linenumber, round(floor(abs(l_extendedprice / 7) / ([0.25, 0.125, 0.03125, 0.5])[1 + l_linenumber % 4] + 0.5) * ([0.25, 0.125, 0.03125, 0.5])[1 + l_linenumber % 4], 6) AS v FROM lineitem")
def ticks(spark, d):
    tick = F.get(F.array(*(F.lit(x) for x in (0.25, 0.125, 0.03125, 0.5))), F.col("l_linenumber") % 4)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(nm.tick_round(F.col("l_extendedprice") / 7, tick), 6).alias("v"))


@query("t9_option_key", "SELECT p_partkey, p_brand || '_' || upper(strftime(DATE '2026-02-23' + p_size, '%b%y')) || '_' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 5 AS VARCHAR) ELSE CAST(p_size AS VARCHAR) || '.5' END || CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS key FROM part")
def keys(spark, d):
    strike = F.when(F.col("p_size") % 2 == 0, (F.col("p_size") * 5).cast("double")).otherwise(F.col("p_size") + 0.5)
    return read(spark, d, "part").select("p_partkey", nm.option_key(F.col("p_brand"), F.date_add(F.to_date(F.lit(AS_OF)), F.col("p_size")), strike, F.col("p_partkey") % 2 == 0).alias("key"))


@query("t10_mixed_fraction", "SELECT p_partkey, p_size + (p_partkey % 8) / 8.0::DOUBLE AS coupon FROM part")
def fractions(spark, d):
    text = F.when(F.col("p_partkey") % 8 == 0, F.col("p_size").cast("string")).otherwise(F.concat_ws(" ", F.col("p_size").cast("string"), F.concat((F.col("p_partkey") % 8).cast("string"), F.lit("/8"))))
    return read(spark, d, "part").select("p_partkey", nm.mixed_fraction(text).alias("coupon"))


PRICED = "WITH " + RESOLVED + ", " + pricing("t_mtm", "rate_mtm", "vol_mtm", "price_mtm")


@query("t11_t12_option_prices", PRICED + " SELECT pos_no, round(oprice, 6) AS price, round(delta, 6) AS delta, round(gamma, 8) AS gamma, round(vega, 5) AS vega, round(theta, 5) AS theta, round(rho, 5) AS rho FROM op WHERE type = 'option'")
def options(spark, d):
    r = resolved(spark, d).where("type = 'option'")
    r = nm.price_options(r, F.col("price_mtm"), F.col("strike"), F.col("t_mtm"), F.col("rate_mtm"), F.col("vol_mtm"), F.col("carry"), F.col("call"), F.col("on_future"), "opt_")
    return r.select("pos_no", *(F.round(f"opt_{c}", n).alias(c) for c, n in (("price", 6), ("delta", 6), ("gamma", 8), ("vega", 5), ("theta", 5), ("rho", 5))))


CHOICE = """ch AS (SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS pos_no, (['auto', 'black', 'bs'])[1 + l_linenumber % 3] AS model, l_extendedprice / l_quantity AS spot, CASE WHEN l_orderkey % 2 = 0 THEN l_extendedprice / l_quantity * 1.01::DOUBLE END AS ahead, p_retailprice AS strike, (l_orderkey % 365 + 1) / 365.0::DOUBLE AS tt, l_tax AS rr, 0.1::DOUBLE + l_discount AS vv, 0.01::DOUBLE AS carry,
 l_linestatus = 'O' AS call, l_partkey % 3 = 0 AS ccy, 0.05::DOUBLE AS rd, CASE WHEN l_partkey % 2 = 0 THEN 0.02::DOUBLE END AS rf FROM lineitem JOIN part ON l_partkey = p_partkey),
rs AS (SELECT *, model = 'black' OR (model = 'auto' AND ahead IS NOT NULL) AS fwd, coalesce(ahead, spot * exp((CASE WHEN ccy AND rf IS NOT NULL THEN rd - rf ELSE rr END) * tt)) AS ff FROM ch)"""


@query("t14_model_choice", "WITH " + CHOICE + ", " + pricing("tt", "rr", "vv", "CASE WHEN fwd THEN ff ELSE spot END") + " SELECT pos_no, round(oprice, 6) AS price, round(delta * CASE WHEN fwd AND ccy AND rf IS NOT NULL THEN exp((rd - rf) * tt) ELSE 1 END, 6) AS delta, round(gamma, 8) AS gamma, round(vega, 5) AS vega FROM op")
def model_choice(spark, d):
    li = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    spot = F.col("l_extendedprice") / F.col("l_quantity")
    args = (
        F.get(F.array(F.lit("auto"), F.lit("black"), F.lit("bs")), F.col("l_linenumber") % 3), spot, F.when(F.col("l_orderkey") % 2 == 0, spot * 1.01), F.col("p_retailprice"), (F.col("l_orderkey") % 365 + 1) / 365, F.col("l_tax"), F.lit(0.1) + F.col("l_discount"), F.lit(0.01),
        F.col("l_linestatus") == "O", F.col("l_partkey") % 3 == 0, F.lit(0.05), F.when(F.col("l_partkey") % 2 == 0, 0.02),
    )
    x = nm.price_by_model(li, *args, prefix="opt_")
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos_no"), *(F.round(f"opt_{c}", n).alias(c) for c, n in (("price", 6), ("delta", 6), ("gamma", 8), ("vega", 5))))


MTM = PRICED + """, m1 AS (SELECT *, CASE WHEN type = 'option' THEN round(round(oprice, 10) / model_tick, 0) * model_tick ELSE price END AS unit_price, CASE WHEN type = 'future' THEN coalesce(trade_price, price) ELSE trade_price END AS entry FROM op WHERE price IS NOT NULL),
m2 AS (SELECT *, (unit_price - entry) * quantity * multiplier AS pnl, CASE WHEN type = 'option' THEN delta ELSE 1 END * quantity * multiplier AS units FROM m1), m3 AS (SELECT m2.*, CASE WHEN type = 'future' THEN pnl ELSE unit_price * quantity * multiplier END AS market_value, abs(price * quantity * multiplier) AS gross_notional, om.mark FROM m2 LEFT JOIN omarks om USING (okey))"""


@query("c12_mark_to_market", MTM + """ SELECT book_id, pos_no, type, asset_class, round(unit_price, 6) AS unit_price, round(entry + 1e-9, 6) AS entry, round(pnl, 4) AS pnl, round(market_value, 4) AS market_value, round(gross_notional, 4) AS gross_notional, round(units, 4) AS delta, round(units * price, 3) AS delta_notional,
 CASE WHEN type = 'option' THEN round(gamma * quantity * multiplier, 6) END AS gamma, CASE WHEN type = 'option' THEN round(vega * quantity * multiplier, 3) END AS vega, CASE WHEN type = 'option' AND model_tick IS NULL THEN 1 ELSE 0 END AS failed FROM m3""")
def mtm(spark, d):
    m = o.mark_to_market(resolved(spark, d))
    own = [F.round("unit_price", 6).alias("unit_price"), F.round(F.col("entry") + 1e-9, 6).alias("entry"), *(F.round(c, 4).alias(c) for c in ("pnl", "market_value", "gross_notional")), F.round("delta_notional", 3).alias("delta_notional")]
    greeks = [F.round(f"greeks.{c}", n).alias(c) for c, n in (("delta", 4), ("gamma", 6), ("vega", 3))]
    return m.select("book_id", "pos_no", "type", "asset_class", *own, *greeks, F.col("error").isNotNull().cast("int").alias("failed"))


@query("j7_option_marks", MTM + " SELECT pos_no, okey AS key, mark, round(round(round(unit_price - mark, 10) / model_tick, 0) * model_tick, 6) AS diff, CASE WHEN mark = 0 THEN 'inf'::DOUBLE ELSE round(100 * round_even(round(round(unit_price - mark, 10) / model_tick, 0) * model_tick / mark, 4), 6) END AS pct FROM m3 WHERE mark IS NOT NULL")
def option_marks(spark, d):
    m = o.mark_to_market(resolved(spark, d)).where("mark IS NOT NULL")
    return m.select("pos_no", "key", "mark", F.round("validation.diff", 6).alias("diff"), F.round("validation.pct", 6).alias("pct"))


@query("g13_views", MTM + """, b AS (SELECT *, CASE WHEN type = 'equity' THEN 'EQUITY' ELSE 'DERIVATIVE' END AS bucket FROM m3)
SELECT 'asset_class' AS view, asset_class AS name, round(sum(coalesce(market_value, 0)), 2) AS market_value, round(sum(gross_notional), 2) AS gross_notional, round(sum(coalesce(pnl, 0)), 2) AS pnl, count(*) AS n FROM b GROUP BY asset_class
UNION ALL SELECT 'bucket', bucket, round(sum(coalesce(market_value, 0)), 2), round(sum(gross_notional), 2), round(sum(coalesce(pnl, 0)), 2), count(*) FROM b GROUP BY bucket UNION ALL SELECT 'total', 'all', round(sum(coalesce(market_value, 0)), 2), round(sum(gross_notional), 2), round(sum(coalesce(pnl, 0)), 2), count(*) FROM b""")
def views(spark, d):
    return rounded(o.views(o.mark_to_market(resolved(spark, d))), 2)


BUMPS = (-50, -10, 0, 10, 50)


@query("c13_ladder", "WITH " + RESOLVED + f", bumped AS (SELECT * FROM rs, (VALUES {', '.join(f'({float(b)})' for b in BUMPS)}) bb(bump)), " + pricing("t_mtm", "rate_risk", "vol_risk", "price_risk + bump", "bumped") + """ SELECT book_id, bump::DOUBLE AS bump,
 round(sum(coalesce(CASE type WHEN 'option' THEN (oprice - coalesce(trade_price, 0)) * quantity * multiplier WHEN 'future' THEN (price - coalesce(trade_price, price_risk)) * quantity * multiplier ELSE price * quantity END, 0)), 2) AS value, count(*) AS n FROM op GROUP BY book_id, bump""")
def bumped(spark, d):
    x = o.ladder(resolved(spark, d), list(BUMPS))
    return rounded(x.groupBy("book_id", "bump").agg(F.sum("value").alias("value"), F.count("*").alias("n")), 2)


WHOLE_TICKS = lambda v: f"(round(CAST({v} AS DECIMAL(24,10)) * CASE WHEN risk_tick < 0.1 THEN 100 ELSE 2 END, 0)::DOUBLE * risk_tick)"


@query("t19_sensitivities", "WITH " + RESOLVED + ", " + pricing("t_risk", "rate_risk", "vol_risk", "price_risk") + f""", s0 AS (SELECT *, CASE WHEN type = 'option' THEN delta ELSE 1 END AS dl, CASE WHEN type = 'option' THEN gamma ELSE 0 END AS gm, price * 0.01::DOUBLE AS p0, vol_day * price / sqrt(252.0::DOUBLE) AS v0, quantity * mult_risk AS size FROM op),
s1 AS (SELECT *, {WHOLE_TICKS('p0')} AS p1, {WHOLE_TICKS('v0')} AS v1 FROM s0), s2 AS (SELECT *, CASE WHEN p1 = 0 AND p0 <> 0 THEN sign(p0) * risk_tick ELSE p1 END AS ps, CASE WHEN v1 = 0 AND v0 <> 0 THEN sign(v0) * risk_tick ELSE v1 END AS vs FROM s1)
SELECT pos_no, round(ps, 6) AS pct_step, round(vs, 6) AS day_step, round(dl * ps * size, 4) AS pct_linear, round(gm * ps * ps / 2 * size, 4) AS pct_convex, round(coalesce((dl * ps + gm * ps * ps / 2) * size, 0), 4) AS base, round((dl * vs + gm * vs * vs / 2) * size, 4) AS vol_1d FROM s2""")
def sens(spark, d):
    x = o.sensitivities(resolved(spark, d))
    return x.select("pos_no", F.round("pct_step", 6).alias("pct_step"), F.round("day_step", 6).alias("day_step"), *(F.round(c, 4).alias(c) for c in ("pct_linear", "pct_convex", "base", "vol_1d")))


@query("j17_update_report", """WITH upd AS (SELECT o_orderkey AS seq, 'S' || (o_custkey % 500) AS symbol, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS type, (o_orderkey % 90)::INT AS expiry_days FROM orders),
ps AS (SELECT p_partkey AS pos_no, 'S' || (p_partkey % 450) AS symbol, ([ 'O', 'F', 'P'])[1 + p_partkey % 3] AS type, p_size AS expiry_days FROM part),
h AS (SELECT u.seq, u.symbol, u.expiry_days AS nw, p.pos_no, p.expiry_days AS old0 FROM upd u LEFT JOIN ps p ON u.symbol = p.symbol AND (u.type IS NULL OR u.type = p.type) QUALIFY row_number() OVER (PARTITION BY u.seq ORDER BY p.pos_no) = 1),
c AS (SELECT *, coalesce(lag(nw) OVER (PARTITION BY pos_no ORDER BY seq), old0) AS old FROM h) SELECT seq, symbol, CASE WHEN pos_no IS NULL THEN 'not_found' WHEN nw = old THEN 'none' ELSE 'changed' END AS status, CASE WHEN pos_no IS NOT NULL AND nw <> old THEN old END AS old_days FROM c""")
def updates(spark, d):
    u = read(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("S"), (F.col("o_custkey") % 500).cast("string")).alias("symbol"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("type"), (F.col("o_orderkey") % 90).cast("int").alias("expiry_days"), F.lit(None).cast("double").alias("trade_price"), F.lit(None).cast("double").alias("q"))
    ps = read(spark, d, "part").select(F.col("p_partkey").alias("pos_no"), F.concat(F.lit("S"), (F.col("p_partkey") % 450).cast("string")).alias("symbol"), F.get(F.array(F.lit("O"), F.lit("F"), F.lit("P")), (F.col("p_partkey") % 3).cast("int")).alias("type"), F.col("p_size").alias("expiry_days"), F.lit(0.0).alias("trade_price"), F.lit(0.0).alias("q"))
    report = o.update_positions(ps, u)[1]
    return report.select("seq", "symbol", "status", F.get("changes", F.lit(0))["old"].cast("int").alias("old_days"))


@query("g14_pnl_breakdown", MTM + " SELECT book_id, round(sum(coalesce(pnl, 0)), 2) AS total, round(sum(CASE WHEN type = 'equity' THEN coalesce(pnl, 0) ELSE 0 END), 2) AS equity, round(sum(CASE WHEN type = 'equity' THEN 0 ELSE coalesce(pnl, 0) END), 2) AS other FROM m3 GROUP BY book_id")
def breakdown(spark, d):
    return rounded(o.pnl_breakdown(o.mark_to_market(resolved(spark, d)), ["book_id"]), 2)


@query("g15_reconciliation", MTM + """, g AS (SELECT *, CASE type WHEN 'equity' THEN price_risk * quantity WHEN 'future' THEN (price_risk - coalesce(trade_price, price_risk)) * quantity * multiplier ELSE round(round(w * (price * grow * na - strike * dr * nb), 10) / model_tick, 0) * model_tick * quantity * multiplier END AS again FROM m3)
SELECT type, count(*) AS n, count(*) FILTER (abs(market_value - again) > 1e-6 * greatest(abs(market_value), 1)) AS mismatches, count(mark) AS marks, count(*) FILTER (abs(mark - unit_price) >= model_tick / 2) AS off_mark FROM g WHERE market_value IS NOT NULL GROUP BY type""")
def reconciliation(spark, d):
    return o.reconcile(o.mark_to_market(resolved(spark, d))).drop("max_diff")


@query("g9_move_exposures", "SELECT p_partkey, floor(abs(p_retailprice * 0.01::DOUBLE) * 4 + 0.5) / 4 * p_size AS pct_exposure, floor(p_retailprice * (p_size / 64.0::DOUBLE) * 4 + 0.5) / 4 * p_size AS vol_exposure FROM part")
def moves(spark, d):
    x = read(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), (F.col("p_size") / 64.0).alias("vol"), F.lit(0.25).alias("tick"), F.col("p_size").alias("multiplier"))
    return o.move_exposures(x).select("p_partkey", "pct_exposure", "vol_exposure")
