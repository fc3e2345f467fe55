"""Column builders: the normal distribution, ticks, options, rates and interpolation on discount factors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients of the normal distribution's rational approximation (West 2005, after Hart 1968), highest power first.
CDF_P = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_Q = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


#: Months in the keys of options.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def _poly(c: tuple[float, ...], a: Column) -> Column:
    return reduce(lambda s, k: s * a + F.lit(k), c[1:], F.lit(c[0]))


def norm_cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    tail = reduce(lambda s, k: a + F.lit(float(k)) / s, (4, 3, 2, 1), a + F.lit(0.65))
    c = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, e * _poly(CDF_P, a) / _poly(CDF_Q, a)).otherwise(e / tail / F.lit(2.506628274631))
    return F.when(x > 0, 1 - c).otherwise(c)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(2.5066282746310002)


def tick_round(value: Column, tick: Column) -> Column:
    """The nearest multiple of tick, half away from zero; a tick of 0, below or NULL rounds nothing.

    A half counts as one if decimal digits say so and the doubles' quotient falls short by its last digits: it is
    taken up by 4e-15 of itself first. Exact for quotients of up to some 1e13; beyond, doubles hold no fractions of a tick to speak of.
    """
    return F.coalesce(F.rint(value / F.when(tick > 0, tick) * (1 + 4e-15)) * tick, value)


def at_least_a_tick(value: Column, tick: Column) -> Column:
    """tick_round, but a value that isn't 0 moves by one tick at least."""
    r = tick_round(value, tick)
    return F.when((r == 0) & (value != 0) & (tick > 0), F.signum(value) * tick).otherwise(r)


def price_options(df: DataFrame, price: Column, strike: Column, t: Column, rate: Column, vol: Column, carry: Column, call: Column, forward: Column, prefix: str = "") -> DataFrame:
    """df with price, delta, gamma, vega, theta and rho of options, each name after prefix.

    One formula for both models: the cost of carry is rate - carry on a spot price (Black-Scholes) and 0 where
    `forward` is true (Black 76). No time left: the intrinsic value. No volatility: the discounted intrinsic value of
    the forward. The delta is then a step and the other Greeks are 0. Theta takes the carry of a spot price off for puts
    and calls alike. Shared terms are evaluated once a row, a generator a step: in one stage with the other columns of
    a book their code would be a method that the JVM doesn't compile.
    """
    where: dict[str, tuple[int, int]] = {}

    def c(n: str) -> Column:
        k, i = where[n]
        return F.get(F.col(f"_o{k}"), F.lit(i))

    def step(d: DataFrame, **x: Column) -> DataFrame:
        """d with an array of doubles; of structs the optimizer would take fields out below the generator, and lose them."""
        k = len({k for k, _ in where.values()})
        where.update({n: (k, i) for i, n in enumerate(x)})
        return d.select("*", F.explode(F.array(F.array(*(v.cast("double") for v in x.values())))).alias(f"_o{k}"))

    d = step(df, s=price, k=strike, t=t, r=rate.cast("double"), v=vol.cast("double"), w=F.when(call, F.lit(1.0)).otherwise(F.lit(-1.0)), b=F.when(forward, F.lit(0.0)).otherwise(rate - carry), f=forward)
    d = step(d, root=F.when((c("t") > 0) & (c("v") > 0), c("v") * F.sqrt(c("t"))), grow=F.exp((c("b") - c("r")) * c("t")), dr=F.exp(-c("r") * c("t")))
    d = step(d, d1=(F.ln(c("s") / c("k")) + (c("b") + c("v") * c("v") / 2) * c("t")) / c("root"))
    d = step(d, z1=c("w") * c("d1"), z2=c("w") * (c("d1") - c("root")))
    d = step(d, n1=norm_cdf(c("z1")), n2=norm_cdf(c("z2")), pdf=norm_pdf(c("d1")))
    live, flat = c("root").isNotNull(), c("t") > 0
    ahead, now = c("w") * (c("s") * c("grow") - c("k") * c("dr")), c("w") * (c("s") - c("k"))
    pick = lambda value, still, ended: F.when(live, value).when(flat, still).otherwise(ended)
    zero, first, second = F.lit(0.0), c("w") * c("s") * c("grow") * c("n1"), c("w") * c("k") * c("dr") * c("n2")
    d = step(d, price=pick(first - second, F.greatest(ahead, zero), F.greatest(now, zero)))
    out = {
        "price": c("price"),
        "delta": pick(c("w") * c("grow") * c("n1"), F.when(ahead > 0, c("w") * c("grow")).otherwise(zero), F.when(now > 0, c("w")).otherwise(zero)),
        "gamma": pick(c("grow") * c("pdf") / (c("s") * c("root")), zero, zero),
        "vega": pick(c("s") * c("grow") * c("pdf") * c("root") / c("v"), zero, zero),
        "theta": pick(-c("s") * c("grow") * c("pdf") * c("v") * c("v") / (2 * c("root")) - c("r") * second + F.when(c("f") == 1, c("r") * first).otherwise((c("b") - c("r")) * c("s") * c("grow") * c("n1")), zero, zero),
        "rho": pick(F.when(c("f") == 1, -c("t") * c("price")).otherwise(c("t") * second), zero, zero),
    }
    d = step(d, **{f"out_{k}": v for k, v in out.items()})
    return d.select(*(x for x in df.columns if x not in {prefix + k for k in out}), *(c(f"out_{k}").alias(prefix + k) for k in out))


def price_by_model(df: DataFrame, model: Column, spot: Column, forward: Column, strike: Column, t: Column, rate: Column, vol: Column, carry: Column, call: Column, currency: Column, r_dom: Column, r_for: Column, prefix: str = "") -> DataFrame:
    """price_options with the model that each row names: bs, black, or auto, which is Black where there is a forward.

    Black without a forward takes that of the spot: by both rates for a currency, by `rate` otherwise. A currency's
    delta is turned from the forward to the spot; the position in its other Greeks stays.
    """
    black = (model == "black") | ((model == "auto") & forward.isNotNull())
    both = F.coalesce(currency, F.lit(False)) & r_dom.isNotNull() & r_for.isNotNull()
    ahead = F.coalesce(forward, F.when(both, forward_of_spot(spot, t, r_dom, r_for)).otherwise(forward_of_spot(spot, t, rate)))
    d = df.withColumns({"_m_black": black, "_m_turn": F.when(black & both, F.exp((r_dom - r_for) * t)).otherwise(1.0), "_m_price": F.when(black, ahead).otherwise(spot)})
    d = price_options(d, F.col("_m_price"), strike, t, rate, vol, carry, call, F.col("_m_black"), prefix)
    return d.withColumn(prefix + "delta", F.col(prefix + "delta") * F.col("_m_turn")).drop("_m_black", "_m_turn", "_m_price")


def forward_of_spot(s: Column, t: Column, r_dom: Column, r_for: Column | None = None) -> Column:
    return s * F.exp((r_dom - r_for if r_for is not None else r_dom) * t)


def hull_white_convexity(a: Column, sigma: Column, t1: Column, t2: Column) -> Column:
    """What a futures rate from t1 to t2 exceeds the forward rate by."""
    t1 = F.greatest(t1, F.lit(0.0))
    b = lambda x, y: (1 - F.exp(-a * (y - x))) / a
    return sigma * sigma / 2 * b(t1, t2) * (b(F.lit(0.0), t2) * F.exp(-a * t2) + (1 - F.exp(-2 * a * t1)) / (2 * a))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: expressions inside folds are not shared otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once a row: filters and later columns would otherwise have the expressions copied into them. The optimizer moves nothing across a generator."""
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def log_df(ts: Column, ls: Column, t: Column) -> Column:
    """The logarithm of the discount factor at t: linear between the pillars (ts ascending, ls), carried on beyond them."""
    n = F.size(ts)

    def line(k: Column) -> Column:
        x0, x1, y0, y1 = F.get(ts, k - 1), F.get(ts, k), F.get(ls, k - 1), F.get(ls, k)
        return y0 + (y1 - y0) * (t - x0) / (x1 - x0)

    return F.when(n == 1, F.get(ls, F.lit(0))).otherwise(let(F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(ts, lambda x: x < t)))), line))


def zero_rate(df: Column, t: Column, short: Column) -> Column:
    """In percent, of time t in act/360: simple where `short` (maturities up to a year's tenor from the trade date), with annual compounding elsewhere."""
    return 100 * F.when(short, (1 / df - 1) / t).otherwise(F.pow(df, -1 / t) - 1)


def forward_rate(df_begin: Column, df_end: Column, t: Column) -> Column:
    """The simple rate, in percent, over the time t between two discount factors."""
    return 100 * (df_begin / df_end - 1) / t


def flat_daily_rate(df: Column, days: Column, base: float = 360.0) -> Column:
    """The constant daily rate, in percent, that compounds to a discount factor."""
    return 100 * base * (F.pow(1 / df, 1 / days) - 1)


def instantaneous_forward(ts: Column, ls: Column, t: Column, eps: float = 1e-6) -> Column:
    """The slope of the discount factors' logarithm at t, by a central difference that stays at or above 0."""
    low = F.greatest(t - eps, F.lit(0.0))
    return -(log_df(ts, ls, t + eps) - log_df(ts, ls, low)) / (2 * eps)


def option_key(underlying: Column, expiry: Column, strike: Column, call: Column) -> Column:
    """UND_MONYY_STRIKE with C or P; a strike without a fraction has no point."""
    text = strike.cast("string")
    short = F.when(F.contains(text, F.lit(".")) & ~F.contains(text, F.lit("E")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    month = F.get(F.array(*(F.lit(m) for m in MONTHS)), F.month(expiry) - 1)
    return F.concat_ws("_", underlying, F.concat(month, F.lpad((F.year(expiry) % 100).cast("string"), 2, "0")), F.concat(short, F.when(call, "C").otherwise("P")))


def mixed_fraction(text: Column) -> Column:
    """3 7/8 -> 3.875; anything else that isn't a number -> NULL."""
    whole = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)(?:\s+|$)", 1).try_cast("double")
    over, under = F.regexp_extract(text, r"(\d+)/(\d+)\s*$", 1).try_cast("double"), F.regexp_extract(text, r"(\d+)/(\d+)\s*$", 2).try_cast("double")
    return F.when(text.rlike(r"^\s*\d+(\.\d+)?\s*$"), whole).when(text.rlike(r"^\s*(\d+\s+)?\d+/0*[1-9]\d*\s*$"), F.coalesce(whole, F.lit(0.0)) + over / under)
