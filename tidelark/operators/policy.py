"""Scenarios of policy moves at meetings, the daily paths they make, and what they price."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as dt


def path_counts(meetings: int, moves: list[int], max_cuts: int, max_hikes: int, low: int, high: int) -> np.ndarray:
    """Of each (meetings left, cuts, hikes) so far, how many ways on there are that end within the totals, with hikes less cuts between low and high. Numbers from 2**62 on are held as 2**62."""
    c, h = np.arange(max_cuts + 1)[:, None], np.arange(max_hikes + 1)[None, :]
    out = [((low <= h - c) & (h - c <= high)).astype(object) * 1]
    for _ in range(meetings):
        ways = np.zeros_like(out[-1])
        for x in moves:
            down, up = min(max(-x, 0), max_cuts + 1), min(max(x, 0), max_hikes + 1)
            ways[: max_cuts + 1 - down, : max_hikes + 1 - up] += out[-1][down:, up:]
        out.append(np.minimum(ways, 2**62))
    return np.array(out).astype(np.int64)


def path_of(ranks: np.ndarray, counts: np.ndarray, moves: list[int]) -> np.ndarray:
    """The places in moves (ascending) that make the paths of these ranks, a row a path: at each meeting, the ways on of lesser moves are counted off."""
    n, rows = len(counts) - 1, np.arange(len(ranks))
    padded = np.pad(counts, ((0, 0), (0, max(0, -min(moves))), (0, max(0, max(moves)))))
    left, c, h = ranks.copy(), np.zeros(len(ranks), int), np.zeros(len(ranks), int)
    out = np.zeros((len(ranks), n), np.int32)
    for j in range(n):
        ends = np.cumsum([padded[n - j - 1][c + max(-x, 0), h + max(x, 0)] for x in moves], axis=0)
        k = (left[None, :] >= ends).sum(0)
        left -= np.where(k > 0, ends[np.maximum(k - 1, 0), rows], 0)
        x = np.array(moves)[k]
        c, h = c + np.maximum(-x, 0), h + np.maximum(x, 0)
        out[:, j] = k
    return out


#: Ranks that one row of ranges stands for.
RANKS = 32768


def scenarios(bases: DataFrame, meetings: list, moves: list[int], step: float = 0.0025, max_cuts: int = 2, max_hikes: int = 2, floor: float | None = None, cap: float | None = None, contiguous: bool = False) -> DataFrame:
    """(base_id, scenario_id, total_cuts, total_hikes, cut_dates, hike_dates, terminal_rate) for every path of moves.

    bases: (base_id, initial_rate). The paths of a base that end within the totals, floor and cap are counted by (meetings
    left, cuts, hikes); tasks are dealt ranges of their ranks and make those paths alone, so that nothing is made to be dropped, one base is
    the work of many tasks and the plan doesn't grow with the meetings. A path's id is its place in the enumeration of all paths of moves,
    or with contiguous its rank among those kept, from 0. A base without a rate has no paths under a floor or cap, and all of them,
    with no terminal rate, without.
    """
    moves, kinds = sorted(moves), dict(bases.dtypes)
    nets = F.sequence(F.lit(-max_cuts), F.lit(max_hikes))
    end = lambda n: F.col("initial_rate") + n * step
    if floor is not None:
        nets = F.filter(nets, lambda n: end(n) >= floor)
    if cap is not None:
        nets = F.filter(nets, lambda n: end(n) <= cap)
    b = bases.select("base_id", "initial_rate", F.array_min(nets).alias("low"), F.array_max(nets).alias("high")).where("low IS NOT NULL")
    known: dict[tuple[int, int], np.ndarray] = {}

    def counts(low: int, high: int) -> np.ndarray:
        if (low, high) not in known:
            known[low, high] = path_counts(len(meetings), moves, max_cuts, max_hikes, low, high)
        return known[low, high]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (low, high) in enumerate(zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True)):
                n = int(counts(low, high)[-1, 0, 0])
                if n >= 2**62:
                    raise OverflowError("more paths than ranks can number")
                for first in range(0, n, RANKS * 1024):
                    begin = np.arange(first, min(n, first + RANKS * 1024), RANKS)
                    row = batch.take(pa.array(np.full(len(begin), i)))
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array(begin), pa.array(np.minimum(begin + RANKS, n))], [*row.schema.names, "begin", "finish"])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (low, high, begin, finish) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("low", "high", "begin", "finish")), strict=True)):
                ranks = np.arange(begin, finish)
                digits = path_of(ranks, counts(low, high), moves)
                row = batch.select(["base_id", "initial_rate"]).take(pa.array(np.full(len(ranks), i)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ranks) + 1) * len(meetings), pa.int32()), pa.array(digits.ravel()))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array(ranks), lists], ["base_id", "initial_rate", "rank", "digits"])

    head = f"base_id {kinds['base_id']}, initial_rate {kinds['initial_rate']}"
    r = b.mapInArrow(ranges, f"{head}, low int, high int, begin bigint, finish bigint").repartition("base_id", "begin")
    d = r.mapInArrow(paths, f"{head}, rank bigint, digits array<int>")
    days = F.array(*(F.to_date(F.lit(str(m))) for m in meetings)).cast("array<date>")
    d = d.withColumn("_x", F.transform("digits", lambda i: F.get(F.array(*map(F.lit, moves)), i)))
    total = lambda sign: F.aggregate("_x", F.lit(0), lambda s, x: s + F.greatest(x * sign, F.lit(0)))
    d = d.withColumns({"total_cuts": total(-1), "total_hikes": total(1)}).withColumn("terminal_rate", F.col("initial_rate") + (F.col("total_hikes") - F.col("total_cuts")) * step)

    def text(sign: int) -> Column:
        a = F.filter(F.transform("_x", lambda x, i: F.when(x * sign > 0, F.date_format(F.get(days, i), "yyyy-MM-dd"))), lambda s: s.isNotNull())
        return F.when(F.size(a) > 0, F.array_join(a, ", "))

    number = F.col("rank") if contiguous else F.aggregate("digits", F.lit(0).cast("decimal(38,0)"), lambda s, i: (s * len(moves) + i).cast("decimal(38,0)"))
    terminal = F.col("terminal_rate") if contiguous else F.bround("terminal_rate", 6)
    return d.select("base_id", "initial_rate", number.cast("decimal(38,0)").alias("scenario_id"), "total_cuts", "total_hikes", text(-1).alias("cut_dates"), text(1).alias("hike_dates"), terminal.alias("terminal_rate"))


def dates_of(text: Column) -> Column:
    return F.coalesce(F.transform(F.split(text, ","), lambda s: F.to_date(F.trim(s))), F.array().cast("array<date>"))


def with_cut_dates(sc: DataFrame, meetings: list, t0: str, horizon: int) -> DataFrame:
    """sc whose cut_dates, where they are NULL, are those of cut_indices: places, from 0, among the meetings not before t0. Dates on or before t0, or beyond the horizon, are left out."""
    ahead = F.array(*(F.to_date(F.lit(m)) for m in sorted(map(str, meetings)) if m >= t0)).cast("array<date>")
    named = F.when(F.col("cut_dates").isNotNull(), dates_of(F.col("cut_dates"))).otherwise(F.transform(F.coalesce("cut_indices", F.array().cast("array<int>")), lambda i: F.get(ahead, i)))
    kept = F.filter(named, lambda x: (x > F.to_date(F.lit(t0))) & (x <= F.date_add(F.to_date(F.lit(t0)), horizon)))
    return sc.withColumn("cut_dates", F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: F.date_format(x, "yyyy-MM-dd")), ", ")))


def daily_paths(sc: DataFrame, t0: str, horizon: int, cut_size: float, hike_size: float | None = None, base: float = 360.0, spread: float = 0.0, hikes: bool = True) -> DataFrame:
    """sc exploded into (day_idx, date, policy, repo, t, df) for day 1 to horizon.

    The policy rate moves on meeting days; discount factors multiply from day to day. Each scenario's days stay together.
    """
    hike_size = cut_size if hike_size is None else hike_size
    d = sc.withColumns({"_c": dates_of(F.col("cut_dates")), "_h": dates_of(F.col("hike_dates")) if hikes else F.array().cast("array<date>")})
    d = d.withColumn("day_idx", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("date", F.date_add(F.to_date(F.lit(t0)), F.col("day_idx")))
    # moves so far: what lies in the lists up to the day, which needs no window
    past = lambda a: F.size(F.filter(F.array_distinct(a), lambda x: (x <= F.col("date")) & (x > F.to_date(F.lit(t0)))))
    d = d.withColumn("policy", F.col("initial_rate") - cut_size * past("_c") + hike_size * past("_h")).withColumn("repo", F.col("policy") + spread)
    w = Window.partitionBy("base_id", "scenario_id").orderBy("day_idx").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"t": F.col("day_idx") / base, "df": F.exp(-F.sum(F.ln(1 + F.col("repo") / base)).over(w))})
    return d.drop("_c", "_h")


def accumulation(paths: DataFrame, base: float) -> DataFrame:
    """(base_id, scenario_id, accum, yield_2y): growth of one unit over the path, and the semi-annual yield of two years of it."""
    a = paths.groupBy("base_id", "scenario_id").agg(F.exp(F.sum(F.ln(1 + F.col("repo") / base))).alias("accum"))
    return a.withColumn("yield_2y", 2 * (F.pow("accum", F.lit(0.25)) - 1))


def df_between(dfs: Column, t: Column, base: float) -> Column:
    """The discount factor at t from those at 1/base, 2/base, ...: linear between them, flat beyond the ends, 1 at or before 0."""
    n, at = F.size(dfs), t * base
    k = F.floor(at).cast("int")
    y0, y1 = F.get(dfs, k - 1), F.get(dfs, k)
    return F.when(t <= 0, F.lit(1.0)).when(k < 1, F.get(dfs, F.lit(0))).when(k >= n, F.get(dfs, n - 1)).otherwise(y0 + (y1 - y0) * (at - k))


#: Parts that the bonds of one coupon and maturity are dealt into.
PARTS = 16


def price_bonds(paths: DataFrame, bonds: DataFrame, settlement: str, base: float, face: float = 100.0, freq: int = 2) -> DataFrame:
    """(base_id, scenario_id, bond_id, dirty, clean, accrued, ytm) of bonds (bond_id, coupon, maturity) on each scenario's daily discount factors.

    A price depends on coupon and maturity: bonds alike in both are priced once, and each takes its prices by them.
    """
    curve = paths.groupBy("base_id", "scenario_id").agg(F.array_sort(F.collect_list(F.struct("t", "df"))).alias("c"))
    curve = curve.select("base_id", "scenario_id", F.transform("c", lambda x: x["df"]).alias("dfs"))
    settle = F.to_date(F.lit(settlement))
    b = bonds.select("coupon", "maturity").distinct().withColumn("dates", dt.backward_schedule(F.col("maturity"), settle)).where(F.size("dates") > 0)
    b = b.repartition(int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    j = b.crossJoin(F.broadcast(curve))  # every scenario prices every kind of bond
    pay = F.col("coupon") / freq * face
    n = F.size("dates")
    pv = F.aggregate(F.transform("dates", lambda d, i: (pay + F.when(i == n - 1, face).otherwise(0.0)) * df_between(F.col("dfs"), F.datediff(d, settle) / 365.0, base)), F.lit(0.0), lambda s, x: s + x)
    nxt = F.get("dates", F.lit(0))
    prev = F.add_months(nxt, -6)
    accrued = pay * F.datediff(settle, prev) / F.datediff(nxt, prev)
    j = j.select("base_id", "scenario_id", "coupon", "maturity", n.alias("n"), accrued.alias("accrued"), F.explode(F.array(pv)).alias("dirty"))
    j = j.withColumn("clean", F.col("dirty") - F.col("accrued")).withColumn("ytm", yield_of(F.col("dirty"), F.col("coupon"), F.col("n"), face, freq))
    j = j.groupBy("coupon", "maturity").agg(F.collect_list(F.struct("base_id", "scenario_id", "dirty", "clean", "accrued", "ytm")).alias("prices"))  # one a scenario, as in the broadcast
    j = j.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    own = bonds.select("bond_id", "coupon", "maturity", F.pmod(F.xxhash64("bond_id"), F.lit(PARTS)).cast("int").alias("part"))
    same = F.col("o.coupon").eqNullSafe(F.col("j.coupon")) & (F.col("o.maturity") == F.col("j.maturity")) & (F.col("o.part") == F.col("j.part"))
    out = own.alias("o").join(j.alias("j"), same).select("bond_id", F.inline("prices"))
    return out.select("base_id", "scenario_id", "bond_id", "dirty", "clean", "accrued", "ytm")


def yields(dirty: np.ndarray, coupon: np.ndarray, periods: np.ndarray, face: float, freq: int, low: float, high: float, rounds: int) -> np.ndarray:
    """The yields of yield_of, not a number where there is none."""

    def price(y: np.ndarray) -> np.ndarray:
        small, whole = np.abs(y) < 1e-12, (1 / (1 + y / freq)) ** periods
        return coupon / freq * face * np.where(small, periods, (1 - whole) / np.where(small, 1.0, y / freq)) + face * whole

    with np.errstate(all="ignore"):
        a, z = np.full(len(dirty), low), np.full(len(dirty), high)
        there = (price(a) >= dirty) & (price(z) <= dirty)
        for _ in range(rounds):
            mid = (a + z) / 2
            above = price(mid) > dirty
            a, z = np.where(above, mid, a), np.where(above, z, mid)
        return np.where(there, (a + z) / 2, np.nan)


def yield_of(dirty: Column, coupon: Column, periods: Column, face: float = 100.0, freq: int = 2, low: float = -0.5, high: float = 1.0, rounds: int = 60) -> Column:
    """The yield at which whole periods price to dirty, by bisection of a batch of rows at a time; NULL if it isn't between low and high."""

    @F.arrow_udf("double")
    def found(d: pa.Array, c: pa.Array, n: pa.Array) -> pa.Array:
        y = yields(*(x.to_numpy(zero_copy_only=False).astype(float) for x in (d, c, n)), face, freq, low, high, rounds)
        return pa.array(y, mask=np.isnan(y))

    return found(dirty.cast("double"), coupon.cast("double"), periods.cast("double"))


def rank_delivery(basket: DataFrame, futures: DataFrame, as_of: str) -> DataFrame:
    """The deliverable bonds of every contract and month by implied repo, cheapest to deliver first.

    basket: (contract, delivery_month, cusip, cf, cash); futures: (contract, delivery_month, price, delivery_date). Rows
    without a conversion factor are no part of a basket.
    """
    b = basket.where("cf IS NOT NULL").join(futures, ["contract", "delivery_month"])
    days = F.datediff("delivery_date", F.to_date(F.lit(as_of)))
    b = b.withColumns({"invoice": F.col("price") * F.col("cf"), "days": days}).withColumn("gross_basis", F.col("cash") - F.col("invoice"))
    b = b.withColumn("implied_repo", F.try_divide((F.col("invoice") - F.col("cash")) * 360, F.col("cash") * F.col("days")))
    w = Window.partitionBy("contract", "delivery_month").orderBy(F.desc_nulls_last("implied_repo"), "cusip")
    return b.withColumn("rank", F.rank().over(w))
