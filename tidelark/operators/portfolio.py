"""Mark-to-market and risk of books of positions: equities, futures and options, in one projection over their dimensions.

positions: book_id, pos_no, type (equity, future, option), symbol, quantity, trade_price, strike, expiry, expiry_days,
option_type, underlying_type, underlying_symbol, q, vol, rate, open. Missing is NULL. as_of replaces today's date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as nm

RATE = 0.04


def resolve(positions: DataFrame, marks: DataFrame, vols: DataFrame, specs: DataFrame, option_marks: DataFrame | None = None, as_of: str = "2026-02-23", rate: float = RATE) -> DataFrame:
    """Open positions of known types with what valuation and risk need, which follow rules of their own.

    price_mtm: the symbol's own price; of an option the underlying's first. price_risk: the underlying's first for all.
    vol_mtm: the symbol's own volatility, the position's, 0.2; vol_risk: own, underlying's, position's, 0.2; vol_day: own
    and, for options, the underlying's, or NULL. Multiplier and ticks of options on futures are those of the underlying
    (multiplier 1 without a spec; the tick of model prices that of its root, the symbol less three characters, or NULL),
    of risk moves those of the underlying or the symbol. A position's own rate holds for valuing options on a spot price
    alone. Expiry is a date or, in risk steps, days first; without either 30 days, and never under a millionth of a year.
    """
    p = positions.where(F.coalesce(F.col("open"), F.lit(True)) & F.col("type").isin("equity", "future", "option"))
    root = lambda c: F.expr(f"substring({c}, 1, greatest(0, length({c}) - 3))")
    p = p.withColumns({"_und": F.coalesce("underlying_symbol", "symbol"), "_own": F.col("symbol")}).withColumns({"_und_root": root("_und"), "_own_root": root("_own")})
    every = marks.select("symbol", "price").join(vols.select("symbol", "vol"), "symbol", "full").join(specs.select("symbol", "multiplier", "tick_size"), "symbol", "full")  # all that is known of a symbol
    roots = specs.select("symbol", "tick_size", "asset_class")
    looked_up = [(every, "_und", {"price": "price_und", "vol": "vol_und", "multiplier": "mult_und", "tick_size": "tick_und"}), (every, "_own", {"price": "price_own", "vol": "vol_own", "multiplier": "mult_own"})]
    looked_up += [(roots, "_und_root", {"tick_size": "root_tick"}), (roots, "_own_root", {"asset_class": "root_class"})]
    for dim, key, names in looked_up:
        p = p.join(dim.select(F.col("symbol").alias("_k"), *(F.col(a).alias(b) for a, b in names.items())), F.col(key) == F.col("_k"), "left").drop("_k")
    option = F.col("type") == "option"
    on_future = option & F.col("underlying_type").eqNullSafe(F.lit("future"))
    equity = (F.col("type") == "equity") | F.col("underlying_type").eqNullSafe(F.lit("equity"))
    today = F.to_date(F.lit(as_of))
    by_date, by_days = F.datediff("expiry", today).cast("double"), F.col("expiry_days").cast("double")
    years = lambda *days: F.greatest(F.coalesce(*days, F.lit(30.0)) / 365, F.lit(1e-6))
    one, hundred = F.lit(1.0), F.lit(100.0)
    p = p.withColumns(
        {
            "on_future": on_future,
            "price_risk": F.coalesce("price_und", "price_own"),
            "price_mtm": F.when(option, F.coalesce("price_und", "price_own")).otherwise(F.col("price_own")),
            "asset_class": F.when(equity, "Equity").when(F.col("root_class") == "", "DerivUnknown").otherwise(F.coalesce("root_class", F.lit("Unknown"))),
            "multiplier": F.when(on_future, F.coalesce("mult_und", one)).when(option, hundred).when(F.col("type") == "future", F.coalesce("mult_own", one)).otherwise(one),
            "mult_risk": F.when(on_future | (F.col("type") == "future"), F.coalesce("mult_und", one)).when(option, hundred).otherwise(one),
            "model_tick": F.when(on_future, F.col("root_tick")).when(option, F.lit(0.01)),
            "risk_tick": F.when(on_future | (F.col("type") == "future"), F.coalesce("tick_und", F.lit(0.01))).otherwise(0.01),
            "t_mtm": years(by_date, by_days),
            "t_risk": years(by_days, F.greatest(by_date, F.lit(0.0))),
            "vol_mtm": F.coalesce("vol_own", "vol", F.lit(0.2)),
            "vol_risk": F.coalesce("vol_own", "vol_und", "vol", F.lit(0.2)),
            "vol_day": F.when(option, F.coalesce("vol_own", "vol_und")).otherwise(F.col("vol_own")),
            "rate_mtm": F.when(on_future, F.lit(rate)).otherwise(F.coalesce("rate", F.lit(rate))),
            "rate_risk": F.lit(rate),
            "carry": F.coalesce("q", F.lit(0.0)),
            "call": F.coalesce(F.lower("option_type") == "call", F.lit(True)),
        }
    )
    expiry = F.coalesce("expiry", F.date_add(today, F.col("expiry_days")))
    p = p.withColumn("key", F.when(option & expiry.isNotNull(), nm.option_key(F.col("_und"), expiry, F.col("strike"), F.lower("option_type").startswith("c"))))
    p = p.drop("_und", "_own", "_und_root", "_own_root")
    if option_marks is None:
        return p.withColumn("mark", F.lit(None).cast("double"))
    om = option_marks.select(F.col("option_key").alias("key"), F.col("unit_price").alias("mark"))
    return p.join(om, "key", "left")


def _priced(df: DataFrame, price: Column, rule: str, prefix: str = "_") -> DataFrame:
    """Black on futures, Black-Scholes on all else, by the time, rate and volatility of a rule (mtm, risk, or ladder). Rows that are no options have NULL, which costs no exponential."""
    t, r, v = {"mtm": ("t_mtm", "rate_mtm", "vol_mtm"), "risk": ("t_risk", "rate_risk", "vol_risk"), "ladder": ("t_mtm", "rate_risk", "vol_risk")}[rule]
    return nm.price_options(df, F.when(F.col("type") == "option", price), F.col("strike"), F.col(t), F.col(r), F.col(v), F.col("carry"), F.col("call"), F.col("on_future"), prefix)


def mark_to_market(resolved: DataFrame) -> DataFrame:
    """One row a position with a price: model price, entry, profit, market value, notional, Greeks in units of the book, and how the model's price meets the mark.

    A future's market value is its profit, and its entry the price if it has none; an equity or option without an entry
    has no profit. Option prices are rounded to ticks before the profit; an option on a future without a tick for its
    root keeps NULL values and error says so. Equities and futures have a delta and no other Greeks.
    """
    option = F.col("type") == "option"
    d = _priced(resolved.withColumn("price", F.col("price_mtm")).where("price IS NOT NULL"), F.col("price"), "mtm")
    d = nm.once(d, unit_price=F.when(option, F.when(F.col("model_tick").isNotNull(), nm.tick_round(F.col("_price"), F.col("model_tick")))).otherwise(F.col("price")))
    size = F.col("quantity") * F.col("multiplier")
    d = d.withColumn("entry", F.when(F.col("type") == "future", F.coalesce("trade_price", "price")).otherwise(F.col("trade_price")))
    d = d.withColumn("pnl", (F.col("unit_price") - F.col("entry")) * size)
    d = d.withColumn("market_value", F.when(F.col("type") == "future", F.col("pnl")).otherwise(F.col("unit_price") * size))
    d = d.withColumn("gross_notional", F.abs(F.col("price") * size))
    unit = ("delta", "gamma", "vega", "theta", "rho")
    greeks = F.struct(*((F.when(option, F.col(f"_{k}")).otherwise(F.lit(1.0 if k == "delta" else None)) * size).alias(k) for k in unit))
    d = d.withColumn("greeks", greeks).withColumn("delta_notional", F.col("greeks.delta") * F.col("price"))
    diff = F.when(F.col("mark").isNotNull(), nm.tick_round(F.col("unit_price") - F.col("mark"), F.col("model_tick")))
    d = d.withColumn("_diff", diff)
    pct = F.when(F.col("mark") == 0, F.when(F.col("_diff").isNotNull(), F.lit(float("inf")))).otherwise(100 * F.bround(F.try_divide("_diff", "mark"), 4))
    d = d.withColumns({"validation": F.struct("mark", F.col("_diff").alias("diff"), pct.alias("pct")), "error": F.when(option & F.col("model_tick").isNull(), "no tick size for the contract's root")})
    return d.drop("_price", "_diff", *(f"_{k}" for k in unit))


def sensitivities(resolved: DataFrame, pct_move: float = 0.01) -> DataFrame:
    """resolved with base and vol_1d: what a relative move and a one-day move of the volatility make in cash, and their linear and convex parts.

    Moves are of whole ticks, at least one. Without a price base is 0; vol_1d is NULL without a price or volatility.
    """
    option = F.col("type") == "option"
    price, size = F.col("price_risk"), F.col("quantity") * F.col("mult_risk")
    d = _priced(resolved, price, "risk").drop("_price", "_vega", "_theta", "_rho")
    d = d.withColumns({"_delta": F.when(option, F.col("_delta")).otherwise(1.0), "_gamma": F.when(option, F.col("_gamma")).otherwise(0.0)})
    daily = F.when(F.col("vol_day") > 0, F.col("vol_day") * price / F.sqrt(F.lit(252.0)))
    d = d.withColumn("pct_step", nm.at_least_a_tick(price * pct_move, F.col("risk_tick"))).withColumn("day_step", nm.at_least_a_tick(daily, F.col("risk_tick")))
    for name in ("pct", "day"):
        step = F.col(f"{name}_step")
        d = d.withColumn(f"{name}_linear", F.col("_delta") * step * size).withColumn(f"{name}_convex", F.col("_gamma") * step * step / 2 * size)
    d = d.withColumns({"base": F.coalesce(F.col("pct_linear") + F.col("pct_convex"), F.lit(0.0)), "vol_1d": F.col("day_linear") + F.col("day_convex")})
    return d.drop("_delta", "_gamma")


def ladder(resolved: DataFrame, bumps: list[float]) -> DataFrame:
    """(book_id, pos_no, bump, value): value of every position with the price moved by each bump, not rounded to ticks.

    An equity's value is quantity times price; a future's is its profit, from its price before the bump if it has no
    entry; an option's is its profit, from 0 if it has none. Without a price the value is 0. The bumps are few and
    given, and multiply the rows by their number.
    """
    d = resolved.withColumn("bump", F.explode(F.array(*(F.lit(float(b)) for b in bumps))))
    moved, size = F.col("price_risk") + F.col("bump"), F.col("quantity") * F.col("multiplier")
    d = _priced(d, moved, "ladder")
    value = F.when(F.col("type") == "option", (F.col("_price") - F.coalesce("trade_price", F.lit(0.0))) * size)
    value = value.when(F.col("type") == "future", (moved - F.coalesce("trade_price", "price_risk")) * size).otherwise(moved * size)
    return d.select("book_id", "pos_no", "bump", F.coalesce(value, F.lit(0.0)).alias("value"))


def views(mtm: DataFrame) -> DataFrame:
    """(view, name, market_value, gross_notional, pnl, n) by asset class, by equities and derivatives (both always; options are derivatives), and in all."""
    b = mtm.withColumn("bucket", F.when(F.col("type") == "equity", "EQUITY").otherwise("DERIVATIVE"))
    sums = [F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("market_value", "gross_notional", "pnl")]
    g = b.groupingSets([["asset_class"], ["bucket"], []], "asset_class", "bucket").agg(*sums, F.count("*").alias("n"), F.grouping_id().alias("g"))
    g = g.select(F.when(F.col("g") == 1, "asset_class").when(F.col("g") == 2, "bucket").otherwise("total").alias("view"), F.coalesce(F.when(F.col("g") == 1, F.col("asset_class")), F.when(F.col("g") == 2, F.col("bucket")), F.lit("all")).alias("name"), "market_value", "gross_notional", "pnl", "n")
    both = mtm.sparkSession.createDataFrame([("bucket", "EQUITY"), ("bucket", "DERIVATIVE")], "view string, name string")
    missing = both.join(g, ["view", "name"], "left_anti").select("view", "name", *(F.lit(0.0).alias(c) for c in ("market_value", "gross_notional", "pnl")), F.lit(0).cast("long").alias("n"))
    return g.unionByName(missing)


def pnl_breakdown(mtm: DataFrame, by: list[str]) -> DataFrame:
    """Profit in all, on equities and on everything else; positions without a profit count as 0."""
    p, e = F.coalesce("pnl", F.lit(0.0)), F.col("type") == "equity"
    return mtm.groupBy(*by).agg(F.sum(p).alias("total"), F.sum(F.when(e, p).otherwise(0.0)).alias("equity"), F.sum(F.when(e, 0.0).otherwise(p)).alias("other"))


def reconcile(mtm: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(type, n, mismatches, max_diff, marks, off_mark): market values against values made anew from the inputs.

    Options are priced by parity from the opposite option. off_mark counts those of the options with a mark whose
    price made anew is a tick or more away from it.
    """
    size, w = F.col("quantity") * F.col("multiplier"), F.when(F.col("call"), 1.0).otherwise(-1.0)
    d = nm.price_options(mtm, F.when(F.col("type") == "option", F.col("price")), F.col("strike"), F.col("t_mtm"), F.col("rate_mtm"), F.col("vol_mtm"), F.col("carry"), ~F.col("call"), F.col("on_future"), "_opp_")
    ahead = F.col("price") * F.exp(-F.when(F.col("on_future"), F.col("rate_mtm")).otherwise(F.col("carry")) * F.col("t_mtm")) - F.col("strike") * F.exp(-F.col("rate_mtm") * F.col("t_mtm"))
    d = d.withColumn("_again", nm.tick_round(F.col("_opp_price") + w * ahead, F.col("model_tick")))
    again = F.when(F.col("type") == "option", F.col("_again") * size).when(F.col("type") == "future", (F.col("price") - F.coalesce("trade_price", "price")) * size).otherwise(F.col("price") * F.col("quantity"))
    d = d.where("market_value IS NOT NULL").withColumn("_off", F.abs(F.col("market_value") - again))
    bad = F.col("_off") > tolerance * F.greatest(F.abs("market_value"), F.lit(1.0))
    off_mark = F.abs(F.col("mark") - F.col("_again")) >= F.col("model_tick") / 2
    return d.groupBy("type").agg(F.count("*").alias("n"), F.count_if(bad).alias("mismatches"), F.max("_off").alias("max_diff"), F.count("mark").alias("marks"), F.count_if(off_mark).alias("off_mark"))


def move_exposures(df: DataFrame, pct: float = 0.01) -> DataFrame:
    """df (price, vol, tick, multiplier) with what a relative move and one standard deviation are worth, in whole ticks."""
    return df.withColumns({"pct_exposure": nm.tick_round(F.col("price") * pct, F.col("tick")) * F.col("multiplier"), "vol_exposure": nm.tick_round(F.col("price") * F.col("vol"), F.col("tick")) * F.col("multiplier")})


def update_positions(positions: DataFrame, updates: DataFrame, fields: tuple[str, ...] = ("expiry_days", "trade_price", "q")) -> tuple[DataFrame, DataFrame]:
    """(positions, report). Each update (seq, symbol, type?, fields) goes to the first position with its symbol, and type if given.

    Updates are applied in order: for each field the last one that isn't NULL holds. report: seq, status (changed,
    none, not_found) and changes, the fields with their values before and after.
    """
    u = updates.select("seq", F.col("symbol").alias("_sym"), F.col("type").alias("_type"), *(F.col(f).alias(f"new_{f}") for f in fields))
    first = F.min_by(F.struct(*positions.columns), "pos_no").alias("p")
    of_symbol = positions.groupBy("symbol").agg(first).select(F.col("symbol").alias("_s"), F.lit(None).cast(dict(positions.dtypes)["type"]).alias("_t"), "p")
    of_type = positions.where("type IS NOT NULL").groupBy("symbol", "type").agg(first).select(F.col("symbol").alias("_s"), F.col("type").alias("_t"), "p")
    hit = u.join(of_symbol.unionByName(of_type), (F.col("_s") == F.col("_sym")) & F.col("_t").eqNullSafe(F.col("_type")), "left").select(*u.columns, "p.*")
    before = Window.partitionBy("pos_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    for f in fields:
        hit = hit.withColumn(f"old_{f}", F.coalesce(F.last(f"new_{f}", ignorenulls=True).over(before), F.col(f)))
    change = F.array(*(F.when(F.col(f"new_{f}").isNotNull() & ~F.col(f"new_{f}").eqNullSafe(F.col(f"old_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").cast("string").alias("old"), F.col(f"new_{f}").cast("string").alias("new"))) for f in fields))
    hit = hit.withColumn("changes", F.filter(change, lambda x: x.isNotNull()))
    report = hit.select("seq", F.col("_sym").alias("symbol"), F.when(F.col("pos_no").isNull(), "not_found").when(F.size("changes") == 0, "none").otherwise("changed").alias("status"), F.when(F.col("pos_no").isNotNull(), F.col("changes")).alias("changes"))
    last = hit.where("pos_no IS NOT NULL").groupBy("pos_no").agg(*(F.max_by(F.col(f"new_{f}"), F.when(F.col(f"new_{f}").isNotNull(), F.col("seq"))).alias(f"new_{f}") for f in fields))
    out = positions.join(last, "pos_no", "left")
    return out.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in positions.columns)), report
