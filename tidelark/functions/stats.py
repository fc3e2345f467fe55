"""Tails of the t and F distributions as columns, and exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import let

#: Coefficients of the gamma function's approximation by Lanczos (g = 7, nine terms).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Of x from 0.5 on."""
    z = x - 1
    series = sum((F.lit(c) / (z + i) for i, c in enumerate(LANCZOS) if i), F.lit(LANCZOS[0]))
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method; its steps grow with the root of a and b."""
    steps = F.sequence(F.lit(1), (F.lit(60) + 6 * F.sqrt(F.greatest(a, b))).cast("int"))
    some = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def one(s: Column, term: Column) -> Column:
        return let(term, lambda q: let(some(1 + q * s["d"]), lambda d: let(some(1 + q / s["c"]), lambda c: F.struct(c.alias("c"), (1 / d).alias("d"), (s["h"] * c / d).alias("h")))))

    def step(s: Column, i: Column) -> Column:
        even = i * (b - i) * x / ((a - 1 + 2 * i) * (a + 2 * i))
        odd = -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 1 + 2 * i))
        return let(one(s, even), lambda t: one(t, odd))

    first = 1 / some(1 - (a + b) * x / (a + 1))
    return F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step, lambda s: s["h"])


def _log_beta(a: Column, b: Column) -> Column:
    """The logarithm of the beta function; of a large argument the ratio of two gamma functions by Stirling's formula, whose large terms cancel before they are summed."""
    big, small = F.greatest(a, b), F.least(a, b)
    ratio = (big - 0.5) * F.log1p(small / big) + small * F.ln(big + small) - small + (1 / (big + small) - 1 / big) / 12
    return log_gamma(small) - F.when(big > 1000, ratio).otherwise(log_gamma(a + b) - log_gamma(big))


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """The regularised incomplete beta function; a and b from 0.5 on, x from 0 to 1, and rest, which is 1 - x without its loss of digits."""
    log = lambda v, w: F.when(w < 0.5, F.log1p(-w)).otherwise(F.ln(v))
    front = F.exp(a * log(x, rest) + b * log(rest, x) - _log_beta(a, b))
    low = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, F.lit(0.0)).when(rest <= 0, F.lit(1.0)).when(low, front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, rest) / b)


def t_tails(t: Column, free: Column) -> Column:
    """The probability of a t statistic at least as far from 0, of `free` degrees of freedom (1 or more); NULL without either."""
    return f_tail(t * t, F.lit(1), free)


def f_tail(f: Column, free1: Column, free2: Column) -> Column:
    """The probability of an F statistic at least as large."""
    a, b = free1.cast("double"), free2.cast("double")
    return F.when((free1 >= 1) & (free2 >= 1), incomplete_beta(b / 2, a / 2, b / (b + a * f), a * f / (b + a * f)))


#: Ranges that a group's values are counted in, at each of the rounds.
RANGES = 4096


def exact_quantiles(df: DataFrame, value: str, by: list[str], shares: list[float], rounds: int = 2) -> DataFrame:
    """by and q, the array of the quantiles of value at `shares`, linear between the two nearest rows, as quantile_cont gives them.

    The values of a group are counted in RANGES ranges; those that hold a wanted place are counted again in narrower ones,
    and only the rows of the last are put in order, in a sort that spills. No task holds a group, or its different values.
    NULL values are left out; a group without others has no row.
    """
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    wanted = F.array(*(F.lit(float(s)) for s in shares))
    n = d.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = F.explode(F.array_distinct(F.flatten(F.transform(wanted, lambda s: F.array(F.floor(s * (F.col("_n") - 1)), F.ceil(s * (F.col("_n") - 1)))))))
    places = n.select(*by, "_n", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), at.alias("_place"))
    rows = d.join(n.select(*by, "_lo", "_hi"), by)
    keys = [*by, "_lo", "_hi"]
    of = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / RANGES)), F.lit(RANGES - 1))).otherwise(0)
    for _ in range(rounds):
        rows = rows.withColumn("_r", of)
        w = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
        counts = rows.groupBy(*keys, "_r").agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")).withColumn("_upto", F.sum("_c").over(w))
        inside = (F.col("_place") - F.col("_before")).between(F.col("_upto") - F.col("_c"), F.col("_upto") - 1)
        found = places.join(counts, keys).where(inside)
        places = found.select(*by, "_n", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_before") + F.col("_upto") - F.col("_c")).alias("_before"), "_place", F.col("_lo").alias("_lo0"), F.col("_hi").alias("_hi0"), "_r")
        kept = places.select(*by, F.col("_lo0").alias("_lo"), F.col("_hi0").alias("_hi"), "_r", F.col("_lo").alias("_lo1"), F.col("_hi").alias("_hi1")).distinct()
        rows = rows.join(kept, [*keys, "_r"]).select(*by, "_v", F.col("_lo1").alias("_lo"), F.col("_hi1").alias("_hi"))
        places = places.drop("_lo0", "_hi0", "_r")
    rows = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("_c").over(w))
    hit = places.join(rows, keys).where((F.col("_place") - F.col("_before")).between(F.col("_upto") - F.col("_c"), F.col("_upto") - 1))
    value_of = F.map_from_entries(F.collect_list(F.struct("_place", "_v")))  # two a share
    out = hit.groupBy(*by).agg(F.first("_n").alias("_n"), value_of.alias("_m"))

    def between(s: Column) -> Column:
        x = s * (F.col("_n") - 1)
        low, high = F.col("_m")[F.floor(x)], F.col("_m")[F.ceil(x)]
        return low + (high - low) * (x - F.floor(x))

    return out.select(*by, F.transform(wanted, between).alias("q"))
