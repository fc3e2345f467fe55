"""Times looked up in the intervals between pillars by an equal join of cells, for tables of any size on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a cell in the unit of t, cells that are told apart (times beyond share the last), and the share of all times, as one in so many, from which a cell is split.
WIDTH, CELLS, SHARE = 1.0, 64, 1000


def pillar_intervals(pillars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t0, t1, l0, l1, low, high) of pillars (keys, t, l): the intervals (low, high] that cover all times, and the pillars whose line holds there.

    The first interval begins, and the last ends, nowhere; a single pillar is one interval with no end (t1 is NULL).
    Repeated pillars count once, with the least l; NULL times or values are left out. A key's pillars are ordered in one task, by a sort that spills.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    p = pillars.where("t IS NOT NULL AND l IS NOT NULL").groupBy(*keys, "t").agg(F.min("l").alias("l"))
    p = p.select(*keys, F.col("t").alias("t0"), F.col("l").alias("l0"), F.lead("t").over(w).alias("t1"), F.lead("l").over(w).alias("l1"), F.row_number().over(w).alias("_n"), F.lead("t", 2).over(w).alias("_t2"))
    p = p.where("t1 IS NOT NULL OR _n = 1")
    low = F.when(F.col("_n") == 1, F.lit(float("-inf"))).otherwise(F.col("t0"))
    high = F.when(F.col("_t2").isNull(), F.lit(float("inf"))).otherwise(F.col("t1"))
    return p.select(*keys, "t0", "t1", "l0", "l1", low.alias("low"), high.alias("high"))


def _cell(t: Column, width: float, cells: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(float(cells)), t / width))).cast("int")))


def discount_factors_at(pillars: DataFrame, times: DataFrame, keys: list[str], width: float = WIDTH, cells: int = CELLS, share: int = SHARE) -> DataFrame:
    """times (keys, t, any more) with df, the discount factor at t on the key's curve of pillars (keys, t, l = ln df).

    As numeric.log_df: linear in l between pillars, carried on beyond them. Every row of times is kept; df is NULL where t is NULL or not
    a number, or the key has no pillars. An interval has a row for each cell that it reaches into, so that key and cell are an equal join and the bounds are checked within.
    A cell with over one in `share` of all times is dealt into parts of that size, with a copy of its intervals each; there
    are fewer than `share` such cells, whatever the data, so that their list may be broadcast.
    """
    names = times.columns
    taken = {"_cell", "_part", "df", "t0", "t1", "l0", "l1", "low", "high"} & set(names + keys)
    if taken:
        raise ValueError(f"columns of times can't have the names {sorted(taken)}")
    at = times.withColumn("_cell", _cell(F.col("t"), width, cells))
    by = [*keys, "_cell"]
    counts = at.where("_cell IS NOT NULL").groupBy(*by).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = counts.where(F.col("_n") * share > total).select(*by, F.ceil(F.col("_n") * share / total).cast("int").alias("_parts"))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    at = at.join(F.broadcast(hot), by, "left").withColumn("_part", F.pmod(F.xxhash64(*names), parts).cast("int")).drop("_parts")
    iv = pillar_intervals(pillars, keys)
    iv = iv.withColumn("_cell", F.explode(F.sequence(_cell(F.col("low"), width, cells), _cell(F.col("high"), width, cells))))
    iv = iv.join(F.broadcast(hot), by, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    a, i = at.alias("a"), iv.alias("i")
    same = [F.col(f"a.{k}") == F.col(f"i.{k}") for k in [*by, "_part"]]
    j = a.join(i, [*same, F.col("a.t") > F.col("i.low"), F.col("a.t") <= F.col("i.high")], "left")
    line = F.col("i.l0") + F.coalesce((F.col("i.l1") - F.col("i.l0")) * (F.col("a.t") - F.col("i.t0")) / (F.col("i.t1") - F.col("i.t0")), F.lit(0.0))
    return j.select(*(F.col(f"a.{c}") for c in names), F.exp(line).alias("df"))
