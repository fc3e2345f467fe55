"""Panels of prices in long form (symbol, date, price): cleaning, returns, rolling statistics, regressions and weights."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import series


def select_contracts(futures: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of the contracts that rules (symbol, maturity) name: of the rule's maturity, with the symbol as ident or, if there is none, idents that begin with it.

    A row that several rules select comes once for each, with the rule's symbol. rules is a small dimension.
    """
    r = rules.withColumnRenamed("maturity", "_maturity")
    names = futures.select(F.col("px_ident").alias("_ident"), F.col("maturity").alias("_maturity")).distinct()  # the prefixes are looked for in these alone
    hit = names.join(r, "_maturity").where(F.col("_ident").startswith(F.col("symbol")))
    exact = F.max(F.col("_ident") == F.col("symbol")).over(Window.partitionBy("symbol", "_maturity"))
    hit = hit.withColumn("_exact", exact).where(~F.col("_exact") | (F.col("_ident") == F.col("symbol")))
    return futures.join(hit, (F.col("px_ident") == F.col("_ident")) & (F.col("maturity") == F.col("_maturity"))).drop("_ident", "_maturity", "_exact")


def default_rules(futures: DataFrame, default: str = "3M", special: dict[str, str] | None = None) -> DataFrame:
    d = futures.select(F.col("px_ident").alias("symbol")).distinct()
    other = reduce(lambda c, kv: c.when(F.col("symbol") == kv[0], kv[1]), (special or {"Y10Y": "1M"}).items(), F)
    return d.withColumn("maturity", other.otherwise(default))


def merge_prices(equities: DataFrame, futures: DataFrame) -> DataFrame:
    """One table (symbol, date, price, volume, asset_type) of both; futures have no volume."""
    for df, need in ((equities, {"trading_date", "ric", "last"}), (futures, {"obs_date", "px_ident"})):
        if missing := need - set(df.columns):
            raise ValueError(f"columns missing: {sorted(missing)}")
    price = "price" if "price" in futures.columns else "last"
    volume = F.col("volume") if "volume" in equities.columns else F.lit(None)
    e = equities.select(F.col("ric").alias("symbol"), F.col("trading_date").alias("date"), F.col("last").alias("price"), volume.cast("double").alias("volume"), F.lit("Equity").alias("asset_type"))
    f = futures.select(F.col("px_ident").alias("symbol"), F.col("obs_date").alias("date"), F.col(price).alias("price"), F.lit(None).cast("double").alias("volume"), F.lit("Future").alias("asset_type"))
    return e.unionByName(f)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def regime(change: Column, band: float = 1.5) -> Column:
    return F.when(change > band, "Steepening").when(change < -band, "Flattening").otherwise("Stable")


def first_values(prices: DataFrame, order: str) -> DataFrame:
    """(symbol, date, price): the first price that isn't NULL of each symbol and date, by `order`."""
    return prices.where("price IS NOT NULL").groupBy("symbol", "date").agg(F.min_by("price", order).alias("price"))


def pivot(prices: DataFrame, symbols: list[str]) -> DataFrame:
    """A column a symbol; fails if a date and symbol come twice."""
    return prices.groupBy("date").pivot("symbol", symbols).agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a date and symbol come twice"))).otherwise(F.first("price")))


def spine(prices: DataFrame) -> DataFrame:
    """Every symbol on every date of the panel, with NULL where it has no price.

    The pairs are those of two small dimensions, dates and symbols, and a row for each is what the result is.
    """
    grid = prices.select("date").distinct().join(F.broadcast(prices.agg(F.collect_set("symbol").alias("s"))))
    return grid.select("date", F.explode("s").alias("symbol")).join(prices, ["symbol", "date"], "left")


def _by(*keys: str):
    return Window.partitionBy(*keys).orderBy("date")


def log_returns(prices: DataFrame, drop: str = "any") -> DataFrame:
    """(symbol, date, ret) on the dates where every symbol has one; a gap voids its day and the next. drop="all" keeps the dates where some symbol has one, with NULL for the others."""
    r = spine(prices).withColumn("ret", F.ln("price") - F.lag(F.ln("price")).over(_by("symbol")))
    ok = r.groupBy("date").agg(F.count("ret").alias("n"), F.count("*").alias("all")).where("n = all" if drop == "any" else "n > 0").select("date")
    return r.join(ok, "date", "left_semi").select("symbol", "date", "ret")


def simple_returns(prices: DataFrame, fill: bool = True) -> DataFrame:
    """(symbol, date, ret) on the spine; with fill, a gap repeats the last price first. Rows without a return are left out."""
    p = F.last("price", ignorenulls=True).over(_by("symbol").rowsBetween(Window.unboundedPreceding, 0)) if fill else F.col("price")
    r = spine(prices).withColumn("p", p)
    return r.withColumn("ret", F.col("p") / F.lag("p").over(_by("symbol")) - 1).where("ret IS NOT NULL").select("symbol", "date", "ret")


def pairs(returns: DataFrame, same: bool = True) -> DataFrame:
    """(date, sym_i, sym_j, x, y) with sym_i <= sym_j: symbols squared rows a date, which a matrix has anyway."""
    a = returns.select("date", F.col("symbol").alias("sym_i"), F.col("ret").alias("x"))
    b = returns.select("date", F.col("symbol").alias("sym_j"), F.col("ret").alias("y"))
    return a.join(b, "date").where(F.col("sym_i") <= F.col("sym_j") if same else F.col("sym_i") < F.col("sym_j"))


def rolling_covariance(returns: DataFrame, window: int = 126) -> DataFrame:
    """(date, sym_i, sym_j, cov, corr) of each full window of rows; a pair's series is split into blocks."""
    columns = {"cov": series.full(lambda w: F.covar_samp("x", "y").over(w), window), "corr": series.full(lambda w: F.corr("x", "y").over(w), window)}
    p = series.rolling(pairs(returns), ["sym_i", "sym_j"], window - 1, columns)
    return p.where(F.col("pos") >= window - 1).select("date", "sym_i", "sym_j", "cov", "corr")


def correlation(returns: DataFrame) -> DataFrame:
    return pairs(returns).groupBy("sym_i", "sym_j").agg(F.corr("x", "y").alias("corr"), F.count("*").alias("n"))


def min_variance_weights(cov: DataFrame) -> DataFrame:
    """(date, symbol, weight) of least variance, for every date's matrix; a singular matrix has NULL weights.

    Each date's matrix is a group of symbols squared rows: the inverse is the one step that columns can't express.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        syms = sorted(set(pdf.sym_i) | set(pdf.sym_j))
        m = pdf.pivot(index="sym_i", columns="sym_j", values="cov").reindex(index=syms, columns=syms).to_numpy()
        m = np.where(np.isnan(m), m.T, m)
        try:
            w = np.linalg.solve(m, np.ones(len(syms)))
            w = w / w.sum() if np.isfinite(w).all() and np.linalg.cond(m) < 1e14 else np.full(len(syms), np.nan)
        except np.linalg.LinAlgError:
            w = np.full(len(syms), np.nan)
        return pd.DataFrame({"date": pdf.date.iloc[0], "symbol": syms, "weight": [None if np.isnan(x) else float(x) for x in w]})

    kind = dict(cov.dtypes)["date"]
    return cov.select("date", "sym_i", "sym_j", "cov").groupBy("date").applyInPandas(solve, f"date {kind}, symbol string, weight double")


def risk_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """(date, symbol, weight, vol, corr_pfl, stand_alone, marginal, contribution, total) from covariances and weights.

    contribution = w S R sums to total, the portfolio's standard deviation.
    """
    full = cov.select("date", F.col("sym_i").alias("i"), F.col("sym_j").alias("j"), "cov").unionByName(cov.where("sym_i <> sym_j").select("date", F.col("sym_j").alias("i"), F.col("sym_i").alias("j"), "cov"))
    wi = weights.select("date", F.col("symbol").alias("i"), F.col("weight").alias("wi"))
    wj = weights.select("date", F.col("symbol").alias("j"), F.col("weight").alias("wj"))
    r = full.join(wj, ["date", "j"]).groupBy("date", "i").agg(F.sum(F.col("cov") * F.col("wj")).alias("cw"), F.sqrt(F.max(F.when(F.col("i") == F.col("j"), F.col("cov")))).alias("vol"))
    r = r.join(wi, ["date", "i"])
    tot = F.sqrt(F.sum(F.col("wi") * F.col("cw")).over(Window.partitionBy("date")))
    r = r.withColumn("total", tot).withColumn("corr_pfl", F.col("cw") / (F.col("vol") * F.col("total")))
    return r.select("date", F.col("i").alias("symbol"), F.col("wi").alias("weight"), "vol", "corr_pfl", (F.col("wi") * F.col("vol")).alias("stand_alone"), (F.col("vol") * F.col("corr_pfl")).alias("marginal"), (F.col("wi") * F.col("vol") * F.col("corr_pfl")).alias("contribution"), "total")


def size_contracts(positions: DataFrame, capital: float) -> DataFrame:
    """positions (weight, unit_value, ...) with contracts (rounded to a tenth half-even, then cut to whole) and the realised share of exposure."""
    c = F.bround(F.col("weight") * capital / F.col("unit_value"), 1).cast("int")
    p = positions.withColumn("contracts", c).withColumn("exposure", F.col("contracts") * F.col("unit_value"))
    if "book" in positions.columns:
        return p.withColumn("share", F.col("exposure") / F.sum("exposure").over(Window.partitionBy("book")))
    total = p.agg(F.sum("exposure").alias("_total"))  # one row
    return p.join(F.broadcast(total)).withColumn("share", F.col("exposure") / F.col("_total")).drop("_total")


def regression(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Least squares of y on x within each group: slope, intercept, r2, adj_r2, standard error, t, F, their p-values and n."""
    a = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*by)
    a = a.agg(*(f(F.col(y), F.col(x)).alias(n) for n, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2), ("n", F.regr_count), ("sxx", F.regr_sxx), ("syy", F.regr_syy), ("sxy", F.regr_sxy))))
    div = F.try_divide  # one row, or one x, has no slope
    sse = F.col("syy") - div(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    a = a.withColumn("slope_se", F.when(F.col("n") > 2, F.sqrt(div(div(sse, F.col("n") - 2), F.col("sxx")))))
    a = a.withColumns({"t": div(F.col("slope"), F.col("slope_se")), "adj_r2": F.when(F.col("n") > 2, 1 - div((1 - F.col("r2")) * (F.col("n") - 1), F.col("n") - 2))}).withColumn("f", F.col("t") * F.col("t"))
    free = F.col("n") - 2
    return a.withColumns({"p_t": stats.t_tails(F.col("t"), free), "p_f": stats.f_tail(F.col("f"), F.lit(1), free)}).drop("sxx", "syy", "sxy")


def durbin_watson(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """The Durbin-Watson statistic of the residuals in the order of date; a group's rows are split into blocks."""
    fit = regression(df, y, x, by).select(*by, "slope", "intercept")
    e = df.join(fit, by).withColumn("e", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)).select(*by, "date", "e")
    e = series.rolling(e, by, 1, {"d": lambda w: F.col("e") - F.lag("e").over(w)})
    return e.groupBy(*by).agg((F.sum(F.col("d") * F.col("d")) / F.sum(F.col("e") * F.col("e"))).alias("dw"))


def rolling_slope(df: DataFrame, y: str, x: str, by: list[str], window: int = 64) -> DataFrame:
    """df with beta over each full window of rows within the group, whose rows are split into blocks."""
    return series.rolling(df, by, window - 1, {"beta": series.full(lambda w: F.regr_slope(F.col(y), F.col(x)).over(w), window)}).drop("pos")


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles and whiskers within 1.5 interquartile ranges of them; the quartiles are exact for groups of any size."""
    q = stats.exact_quantiles(df, value, by, [0.25, 0.5, 0.75]).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    d = df.join(q, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return d.groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("outliers"))


def historical_volatility(prices: DataFrame, window: int = 252) -> DataFrame:
    """(symbol, date, vol): annualised standard deviation of log returns over full windows; NULL before the first."""
    vol = series.full(lambda w: F.stddev_samp("ret").over(w) * np.sqrt(252.0), window)
    return series.rolling(series.log_changes(prices), ["symbol"], window - 1, {"vol": vol}).select("symbol", "date", "vol")


ewma_volatility = series.ewma_volatility


interpolate_in_time = series.interpolate_in_time


def slope_studies(prices: DataFrame, studies: DataFrame) -> DataFrame:
    """(study_id, date, x, y, regime): clipped changes of a slope and of its proxy, for any number of studies at once.

    studies: study_id, near and far (the symbols of the slope, far less near, times scale), proxy_a and proxy_b (a + weight b),
    break_date and break_shift (added to the proxy up to the date), clip_x, clip_y and band. A study takes the dates on which all
    four symbols have a row, fills NULL prices in time, then takes differences. Its series may be of any length.
    """
    legs = studies.select("study_id", F.explode(F.array(*(F.struct(F.lit(c).alias("leg"), F.col(c).alias("symbol")) for c in ("near", "far", "proxy_a", "proxy_b")))).alias("l")).select("study_id", "l.leg", "l.symbol")
    rows = prices.join(legs, "symbol").select(F.concat_ws("|", F.col("study_id").cast("string"), "leg").alias("series"), "study_id", "leg", "date", "price")
    whole = rows.groupBy("study_id", "date").agg(F.count("*").alias("n")).where("n = 4").select("study_id", "date")
    rows = interpolate_in_time(rows.join(whole, ["study_id", "date"]), "price", "series")
    at = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("price"))).alias(leg + "_price")
    d = rows.groupBy("study_id", "date").agg(*map(at, ("near", "far", "proxy_a", "proxy_b"))).join(studies, "study_id")
    slope = (F.col("far_price") - F.col("near_price")) * F.col("scale")
    proxy = F.col("proxy_a_price") + F.col("weight") * F.col("proxy_b_price") + F.when(F.col("date") <= F.col("break_date"), F.col("break_shift")).otherwise(0.0)
    d = d.select("study_id", "date", slope.alias("s"), proxy.alias("q"), "clip_x", "clip_y", "band")
    change = lambda c: (lambda w: F.col(c) - F.lag(c).over(w))
    d = series.rolling(d, ["study_id"], 1, {"dx": change("s"), "dy": change("q")}).where("dx IS NOT NULL AND dy IS NOT NULL")
    within = lambda c, limit: F.greatest(-F.col(limit), F.least(F.col(limit), F.col(c)))
    d = d.select("study_id", "date", within("dx", "clip_x").alias("x"), within("dy", "clip_y").alias("y"), "band")
    kind = F.when(F.col("x") > F.col("band"), "Steepening").when(F.col("x") < -F.col("band"), "Flattening").otherwise("Stable")
    return d.select("study_id", "date", "x", "y", kind.alias("regime"))


def study_results(changes: DataFrame, window: int = 64) -> DataFrame:
    """(study_id, regime, n, slope, intercept, r2, t, p_t, beta) of each study (regime All) and each of its regimes; beta is the last rolling slope, NULL before `window` rows."""
    every = changes.withColumn("regime", F.explode(F.array(F.lit("All"), F.col("regime"))))
    fits = regression(every, "y", "x", ["study_id", "regime"]).select("study_id", "regime", "n", "slope", "intercept", "r2", "t", "p_t")
    last = rolling_slope(every, "y", "x", ["study_id", "regime"], window).groupBy("study_id", "regime").agg(F.max_by("beta", "date").alias("beta"))
    return fits.join(last, ["study_id", "regime"])


def index_to_100(bars: DataFrame, start, end) -> DataFrame:
    d = bars.where(F.col("date").between(F.lit(start), F.lit(end)))
    return d.withColumn("idx", 100 * F.col("price") / F.first("price").over(_by("symbol")))


def position_pnl(prices: DataFrame, positions: DataFrame, capital: float) -> DataFrame:
    """(symbol, date, pnl, ret, grown, cum_pct) of positions (symbol, contracts, multiplier, initial_value) held through prices.

    The first row's profit is against the initial value; grown compounds 1 + ret = 1 + pnl / capital, cum_pct is its gain in percent, to 2 places.
    """
    p = prices.join(positions, "symbol")
    value = F.col("price") * F.col("contracts") * F.col("multiplier")
    p = p.withColumn("_v", value).withColumn("pnl", F.col("_v") - F.coalesce(F.lag("_v").over(_by("symbol")), F.col("initial_value")))
    p = p.withColumn("ret", F.col("pnl") / capital)
    grown = F.product(1 + F.col("ret")).over(_by("symbol").rowsBetween(Window.unboundedPreceding, 0))  # a loss may be over the capital
    return p.select("symbol", "date", "pnl", "ret", grown.alias("grown"), F.bround(100 * (grown - 1), 2).alias("cum_pct"))


def extent(bars: DataFrame, start, end, pad: float = 0.05) -> DataFrame:
    """What a chart of the bars from start to end shows: least low and greatest high, padded."""
    a = bars.where(F.col("dt").between(F.lit(start), F.lit(end))).groupBy("symbol").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    room = (F.col("high") - F.col("low")) * pad
    return a.select("symbol", (F.col("low") - room).alias("low"), (F.col("high") + room).alias("high"))
