"""Discount curves: many bootstraps at once, their repricing, bucket sensitivities, meeting prices and comparisons.

A curve is an array of instruments in one row. Curves are solved in Arrow batches, pillar by pillar for all curves of a
batch, and all bumped copies of them, at once; what a row's pillars then price are plain columns.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as dt
from ..functions import numeric as nm

#: The tenors that curves are repriced at.
GRID = ("1D", "1W", "2W", "3W", "1M", "2M", "3M", "6M", "9M", "12M", "18M", "2Y", "3Y", "4Y", "5Y", "6Y", "7Y", "8Y", "9Y", "10Y", "15Y", "20Y", "25Y", "30Y", "35Y", "40Y", "45Y", "50Y")
HW_A, HW_SIGMA = 0.03, 0.0060


def trade_days(df: DataFrame) -> DataFrame:
    """df with spot_bd, effective and one_year: the next business day, the one after, and a year's tenor, of each trade date."""
    d = nm.once(df, spot_bd=dt.next_business_day(F.col("trade_date")))
    return nm.once(d, effective=dt.next_business_day(F.col("spot_bd")), one_year=dt.add_tenor(F.col("trade_date"), F.lit("1Y")))


def _coupons(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coupons) of df (keys, trade_date, effective, mat): the array of (t, alpha) of annual fixed coupons."""
    s = dt.annual_schedule(df, "effective", "mat")
    w = Window.partitionBy(*keys).orderBy("coupon_no")
    before = F.coalesce(F.lag("coupon_date", 1).over(w), "effective")
    s = s.withColumns({"alpha": dt.act_360(before, F.col("coupon_date")), "t": dt.act_360(F.col("trade_date"), F.col("coupon_date"))})
    return s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "alpha"))).alias("coupons"))  # one a year


def dated(instruments: DataFrame) -> DataFrame:
    """instruments with mat, prev_bd, t, te, t1, alpha, short and coupons. Dates depend on the few different (trade_date, type, tenor, symbol), which they are found for.

    short: up to a year's tenor from the trade date. t1 of a future that accrues already is 0. An unknown type or tenor has a NULL mat.
    """
    keys = ["trade_date", "type", "symbol", "tenor"]
    d = trade_days(instruments.select(*keys).distinct())
    d = nm.once(d, _swap=dt.add_tenor(F.col("effective"), F.col("tenor")), _fut=dt.futures_dates(F.col("symbol"), F.col("trade_date")))
    d = nm.once(d, mat=F.when(F.col("type") == "Rate", F.col("spot_bd")).when(F.col("type") == "Future", F.col("_fut.end")).when(F.col("type") == "Swap", F.col("_swap")))
    start = F.greatest(dt.act_360(F.col("trade_date"), F.col("_fut.start")), F.lit(0.0))
    d = nm.once(d, t=dt.act_360(F.col("trade_date"), F.col("mat")), te=dt.act_360(F.col("trade_date"), F.col("effective")), t1=F.when(F.col("_fut").isNotNull(), start), prev_bd=dt.previous_business_day(F.col("mat")), short=F.col("mat") <= F.col("one_year"))
    d = d.withColumn("alpha", F.when(F.col("type") == "Future", dt.act_360(F.col("_fut.start"), F.col("_fut.end"))).when(F.col("type") == "Swap", dt.act_360(F.col("effective"), F.col("mat"))))
    long = _coupons(d.where((F.col("type") == "Swap") & ~F.col("short")), keys)
    d = d.join(long, keys, "left").select(*keys, "mat", "prev_bd", "t", "te", "t1", "alpha", "short", "coupons")
    return instruments.join(d, keys)


def _df(ts: Column, ls: Column, t: Column) -> Column:
    return F.exp(nm.log_df(ts, ls, t))


def curve_rows(instruments: DataFrame, params: DataFrame) -> DataFrame:
    """(curve_id, trade_date, xs): each curve's instruments in the order of t. Rows without a type, and unknown types, are left out.

    params: (curve_id, trade_date, hw_a, hw_sigma), NULL for the defaults.
    """
    i = dated(instruments.na.drop(subset=["type"])).where("t IS NOT NULL")
    i = i.join(params, ["curve_id", "trade_date"], "left").withColumns({"hw_a": F.coalesce("hw_a", F.lit(HW_A)), "hw_sigma": F.coalesce("hw_sigma", F.lit(HW_SIGMA))})
    i = i.withColumn("ca", F.when(F.col("type") == "Future", nm.hull_white_convexity(F.col("hw_a"), F.col("hw_sigma"), F.col("t1"), F.col("t"))).otherwise(F.lit(0.0)))
    x = F.struct("t", "symbol", "type", "quote", "te", "t1", "alpha", "ca", "coupons", "mat", "prev_bd", "short")
    return i.groupBy("curve_id", "trade_date").agg(F.array_sort(F.collect_list(x)).alias("xs"))  # some tens of instruments


#: Curves that are solved together: a batch's tables are this many times its pillars and coupons.
CURVES = 512
KINDS = ("Rate", "Future", "Swap")


def _table(lists: pa.ListArray, values: np.ndarray, fill: float) -> np.ndarray:
    """The lists as rows of a table, as wide as the longest."""
    starts, ends = lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:]
    n = ends - starts
    at = np.arange(n.max(initial=0))[None, :]
    inside = at < n[:, None]
    out = np.full(inside.shape, fill)
    out[inside] = values[(starts[:, None] + at)[inside]]
    return out


class CurveBatch:
    """The instruments of some curves as tables, a row a curve and a column a place in the order of t."""

    def __init__(self, xs: pa.ListArray):
        x = xs.values
        number = lambda name: _table(xs, x.field(name).to_numpy(zero_copy_only=False).astype(float), np.nan)
        self.n = xs.value_lengths().fill_null(0).to_numpy()
        self.symbols = x.field("symbol").to_pylist()
        self.starts = xs.offsets.to_numpy()[:-1]
        kind = np.array([KINDS.index(k) if k in KINDS else -1 for k in x.field("type").to_pylist()], float)
        self.kind = _table(xs, kind, -1.0)
        self.t, self.quote, self.te, self.t1, self.alpha, self.ca = (number(c) for c in ("t", "quote", "te", "t1", "alpha", "ca"))
        c = x.field("coupons")
        rows = _table(xs, np.arange(len(x), dtype=float), -1.0).astype(int)
        own = [np.vstack([_table(c, c.values.field(f).to_numpy(zero_copy_only=False).astype(float), np.nan).reshape(len(x), -1), np.full((1, max(c.value_lengths().fill_null(0).to_numpy().max(initial=0), 0)), np.nan)]) for f in ("t", "alpha")]
        self.coupon_t, self.coupon_alpha = (v[rows] for v in own)  # curves x places x coupons
        self.long = np.isfinite(self.coupon_t).any(2) if self.coupon_t.shape[2] else np.zeros(self.t.shape, bool)

    def solve(self, bumps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logarithms of discount factors, what stopped the curve) for bumps (curves x copies x places) of the quotes.

        The pillars' times are those of all copies, so that places between them are found once a curve. Stops: the place
        times four plus 1 for a time that doesn't increase, 2 for a factor that isn't positive, 3 for one that rises; -1 for none.
        """
        m, copies, width = bumps.shape
        ls, stop = np.zeros((m, copies, width + 1)), np.full((m, copies), -1)
        ts = np.concatenate([np.zeros((m, 1)), self.t], 1)
        rows = np.arange(m)

        def at(t: np.ndarray, i: int) -> np.ndarray:
            """Discount factors at times (curves x any), from pillars 0 to i, for every copy."""
            if i == 0:
                return np.ones((m, copies, t.shape[1]))
            k = np.clip((ts[:, None, : i + 1] < t[:, :, None]).sum(2), 1, i)
            x0, x1 = ts[rows[:, None], k - 1], ts[rows[:, None], k]
            share = (t - x0) / (x1 - x0)
            y0, y1 = (np.take_along_axis(ls, np.broadcast_to(j[:, None, :], (m, copies, j.shape[1])), 2) for j in (k - 1, k))
            return np.exp(y0 + (y1 - y0) * share[:, None, :])

        with np.errstate(all="ignore"):
            for i in range(width):
                kind, live = self.kind[:, i], i < self.n
                quote = self.quote[:, None, i] + bumps[:, :, i]
                r, alpha = quote / 100, self.alpha[:, None, i]
                df = np.full((m, copies), np.nan)
                if (kind == 0).any():
                    df = np.where((kind == 0)[:, None], 1 / (1 + r * self.t[:, None, i]), df)
                if (kind == 1).any():
                    df = np.where((kind == 1)[:, None], at(self.t1[:, i : i + 1], i)[:, :, 0] / (1 + ((100 - quote) / 100 - self.ca[:, None, i]) * alpha), df)
                if (kind == 2).any():
                    begin = at(self.te[:, i : i + 1], i)[:, :, 0]
                    value = begin / (1 + r * alpha)
                    if self.long[:, i].any():
                        t, a = self.coupon_t[:, i], self.coupon_alpha[:, i]
                        last = np.isfinite(t).sum(1) - 1
                        early = np.arange(t.shape[1])[None, :] < last[:, None]
                        paid = (np.where(early, a, 0.0)[:, None, :] * at(np.where(early, t, 0.0), i)).sum(2)
                        value = np.where(self.long[:, i, None], (begin - r * paid) / (1 + r * a[rows, last][:, None]), value)
                    df = np.where((kind == 2)[:, None], value, df)
                y, before = np.log(df), ls[:, :, i]
                late = np.broadcast_to((self.t[:, i] <= ts[:, i])[:, None], y.shape)
                wrong = np.select([late, ~(df > 0), y > before], [1, 2, 3], 0)
                open_ = (stop < 0) & live[:, None]
                stop = np.where(open_ & (wrong > 0), 4 * i + wrong, stop)
                ls[:, :, i + 1] = np.where(open_ & (wrong == 0), y, before)
        return ls, stop


STOPS = {1: "t does not increase at ", 2: "discount factor not positive at ", 3: "discount factor increases at "}


def bootstrap(rows: DataFrame) -> DataFrame:
    """rows (xs, ...) with ts, ls and status: pillars from (0, 1) on, logarithms of discount factors, and NULL or what stopped the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, CURVES):
                batch = pa.RecordBatch.from_struct_array(pa.concat_arrays([whole.slice(begin, CURVES).to_struct_array()]))
                c = CurveBatch(batch.column("xs"))
                ls, stop = (v[:, 0] for v in c.solve(np.zeros((len(c.n), 1, c.t.shape[1]))))
                n = np.where(stop >= 0, stop // 4, c.n) + 1
                inside = np.arange(ls.shape[1])[None, :] < n[:, None]
                offsets = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[inside])) for v in (np.concatenate([np.zeros((len(n), 1)), c.t], 1), ls)]
                status = pa.array([STOPS[s % 4] + c.symbols[a + s // 4] if s >= 0 else None for s, a in zip(stop.tolist(), c.starts.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists, status], [*batch.schema.names, "ts", "ls", "status"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *T._parse_datatype_string("ts array<double>, ls array<double>, status string").fields]))


def pillars(curves: DataFrame) -> DataFrame:
    """(curve_id, trade_date, pillar_no, symbol, mat, t, df, zero, forward_1d, flat, error_bp): one row a pillar, with the rate of the business day that ends at it and the error of repricing its instrument."""
    p = curves.where("status IS NULL").select("curve_id", "trade_date", "ts", "ls", F.posexplode("xs").alias("n", "x"))
    at = lambda t: _df(F.col("ts"), F.col("ls"), t)
    df = F.exp(F.element_at("ls", F.col("n") + 2))
    days = F.datediff("x.mat", "trade_date")
    overnight = 100 * (at(dt.act_360(F.col("trade_date"), F.col("x.prev_bd"))) / df - 1) / dt.act_360(F.col("x.prev_bd"), F.col("x.mat"))
    annuity = F.aggregate("x.coupons", F.lit(0.0), lambda s, c: s + c["alpha"] * at(c["t"]))
    model = F.when(F.col("x.type") == "Rate", 100 * (1 / df - 1) / F.col("x.t")).when(F.col("x.type") == "Future", 100 * (1 - (at(F.col("x.t1")) / df - 1) / F.col("x.alpha") - F.col("x.ca")))
    model = model.when(F.col("x.coupons").isNull(), 100 * (at(F.col("x.te")) / df - 1) / F.col("x.alpha")).otherwise(100 * (at(F.col("x.te")) - df) / annuity)
    out = p.select("curve_id", "trade_date", (F.col("n") + 1).alias("pillar_no"), "x.symbol", "x.mat", "x.t", df.alias("df"), nm.zero_rate(df, F.col("x.t"), F.col("x.short")).alias("zero"), overnight.alias("forward_1d"), (100 * 360 * (F.pow(1 / df, 1 / days) - 1)).alias("flat"), (100 * (model - F.col("x.quote"))).alias("error_bp"))
    return out


#: Forwards below this are flagged.
LEAST_FORWARD = -0.05


def fit_quality(curves: DataFrame) -> DataFrame:
    """One row a curve: greatest repricing error, least discount factor, range of zero rates, number and end of pillars, and the least of 20 instantaneous forwards from half a year to the end, with a flag if it is under LEAST_FORWARD."""
    p = pillars(curves).groupBy("curve_id", "trade_date").agg(F.max(F.abs("error_bp")).alias("max_error_bp"), F.min("df").alias("min_df"), F.max("zero").alias("max_zero"), F.min("zero").alias("min_zero"), F.count("*").alias("pillars"), F.max("t").alias("last_t"))
    f = curves.where("status IS NULL").select("curve_id", "trade_date", "ts", "ls", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    t = 0.5 + (F.element_at("ts", -1) - 0.5) * F.col("k") / 19
    f = f.groupBy("curve_id", "trade_date").agg(F.min(nm.instantaneous_forward(F.col("ts"), F.col("ls"), t)).alias("min_forward"))
    return p.join(f.withColumn("negative_forward", F.col("min_forward") < LEAST_FORWARD), ["curve_id", "trade_date"])


def bucket_dv01(rows: DataFrame, bump_bp: float = 1.0) -> DataFrame:
    """(curve_id, trade_date, symbol, dv01): what a bump of one quote does to the sum of all discount factors, to 8 places.

    A future's price falls by the bump, other quotes rise. A curve and its bumped copies, one a quote, are solved
    together. Curves without a solution have no rows, a copy without one has NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, CURVES):
                batch = pa.RecordBatch.from_struct_array(pa.concat_arrays([whole.slice(begin, CURVES).to_struct_array()]))
                c = CurveBatch(batch.column("xs"))
                m, width = c.t.shape
                bumps = np.zeros((m, width + 1, width))
                for k in range(width):
                    bumps[:, k, k] = np.where(c.kind[:, k] == 1, -bump_bp / 100, bump_bp / 100)
                ls, stop = c.solve(bumps)
                there = np.arange(width + 1)[None, :] <= c.n[:, None]
                moved = np.where(there[:, None, :], np.exp(ls[:, :-1]) - np.exp(ls[:, -1:]), 0.0).sum(2)
                keep = (np.arange(width)[None, :] < c.n[:, None]) & (stop[:, -1:] < 0)
                curve, place = np.nonzero(keep)
                at = pa.array(curve)
                value = pa.array(moved[keep], mask=stop[:, :-1][keep] >= 0)
                symbols = pa.array([c.symbols[a + p] for a, p in zip(c.starts[curve].tolist(), place.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("curve_id").take(at), batch.column("trade_date").take(at), symbols, value], ["curve_id", "trade_date", "symbol", "dv01"])

    kind = dict(rows.dtypes)
    out = rows.select("curve_id", "trade_date", "xs").mapInArrow(run, f"curve_id {kind['curve_id']}, trade_date {kind['trade_date']}, symbol string, dv01 double")
    return out.withColumn("dv01", F.bround("dv01", 8))


class Grid:
    """The tenor grid of a trade date: its dates, and the times that its rates take discount factors at."""

    def __init__(self, day: datetime.date):
        effective = dt.next_business_date(dt.next_business_date(day))
        one_year = dt.tenor_date(day, "1Y")
        self.mat = [dt.tenor_date(day if g[-1] in "DW" else effective, g) for g in GRID]
        years = lambda a, b: (b - a).days / 360.0
        before = [dt.previous_business_date(m) for m in self.mat]
        self.days = np.array([(m - day).days for m in self.mat], float)
        self.overnight = np.array([years(b, m) for b, m in zip(before, self.mat, strict=True)])
        self.alpha = np.array([years(effective, m) for m in self.mat])
        times = [*(years(day, m) for m in self.mat), *(years(day, b) for b in before), years(day, effective)]
        paid, self.long, self.begins = [], np.array([m > one_year for m in self.mat]), []
        for m in (m for m, long in zip(self.mat, self.long, strict=True) if long):
            self.begins.append(len(paid))
            c = dt.annual_dates(effective, m)
            paid += [(years(day, x), years(y, x)) for x, y in zip(c, [effective, *c], strict=False)]
        self.coupon_alpha = np.array([x for _, x in paid])
        self.times, self.places = np.unique([*times, *(x for x, _ in paid)], return_inverse=True)  # tenors share most coupons

    def prices(self, ts: np.ndarray, ls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(df, par, forward_1d, flat), curves x tenors, rates in percent, of curves with n pillars (0, 1) and on; par is not a number where no time passes."""
        k = np.zeros((len(n), len(self.times)), np.int64)
        for j in range(ts.shape[1]):
            k += ts[:, j, None] < self.times
        k = np.maximum(np.minimum(k, n[:, None] - 1), 1)
        some = n > 1
        with np.errstate(all="ignore"):
            x0, x1, y0, y1 = (np.take_along_axis(v, np.minimum(i, v.shape[1] - 1), 1) for v, i in ((ts, k - 1), (ts, k), (ls, k - 1), (ls, k)))
            at = np.exp(np.where(some[:, None], y0 + (y1 - y0) * (self.times - x0) / (x1 - x0), ls[:, :1]))[:, self.places]
            g = len(GRID)
            df, dfp, dfe = at[:, :g], at[:, g : 2 * g], at[:, 2 * g, None]
            par = np.where(self.alpha != 0, (dfe / df - 1) / self.alpha, np.nan)
            par[:, self.long] = (dfe - df[:, self.long]) / np.add.reduceat(self.coupon_alpha * at[:, 2 * g + 1 :], self.begins, 1)
            return df, 100 * par, 100 * ((dfp / df - 1) / self.overnight), 100 * (360 * ((1 / df) ** (1 / self.days) - 1))


def grids(curves: DataFrame) -> DataFrame:
    """(curve_id, trade_date, grid) of each solved curve with a trade date: its rates on the tenor grid, as an array of (tenor, mat, df, par, forward_1d, flat).

    Days count from the trade date without adjustment, weeks from it with, months and years from the effective date.
    Curves are priced in the batches that they come in: they are solved once, and neither moved nor joined. A batch's trade dates have their grids found once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for whole in batches:
            for begin in range(0, whole.num_rows, CURVES):
                batch = pa.RecordBatch.from_struct_array(pa.concat_arrays([whole.slice(begin, CURVES).to_struct_array()]))
                days = batch.column("trade_date").to_pylist()
                n = batch.column("ts").value_lengths().fill_null(0).to_numpy()
                ts, ls = (_table(batch.column(c), batch.column(c).values.to_numpy(zero_copy_only=False), np.nan) for c in ("ts", "ls"))
                values, mats = np.empty((4, len(n), len(GRID))), np.empty((len(n), len(GRID)), "datetime64[D]")
                of_day: dict = {}
                for i, day in enumerate(days):
                    of_day.setdefault(day, []).append(i)
                for day, rows in of_day.items():
                    if day not in kept:
                        if len(kept) > MOST_GRIDS:
                            kept.clear()
                        kept[day] = Grid(day)
                    values[:, rows] = kept[day].prices(ts[rows], ls[rows], n[rows])
                    mats[rows] = np.array(kept[day].mat, "datetime64[D]")
                df, par, forward, flat = (v.ravel() for v in values)
                columns = [pa.array(list(GRID) * len(n), pa.string()), pa.array(mats.ravel()), pa.array(df), pa.array(par, mask=np.isnan(par)), pa.array(forward), pa.array(flat)]
                offsets = pa.array(np.arange(len(n) + 1) * len(GRID), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("curve_id"), batch.column("trade_date"), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["tenor", "mat", "df", "par", "forward_1d", "flat"]))], ["curve_id", "trade_date", "grid"])

    c = curves.where("status IS NULL AND trade_date IS NOT NULL").select("curve_id", "trade_date", "ts", "ls")
    kind = dict(c.dtypes)
    return c.mapInArrow(run, f"curve_id {kind['curve_id']}, trade_date {kind['trade_date']}, grid array<struct<tenor: string, mat: date, df: double, par: double, forward_1d: double, flat: double>>")


#: Trade dates whose grids a task holds at a time, of some 10 KB each.
MOST_GRIDS = 1024


def reprice_grid(curves: DataFrame) -> DataFrame:
    """(curve_id, trade_date, tenor, mat, df, par, forward_1d, flat) on the tenor grid, rates in percent: a row for each entry of grids."""
    return grids(curves).select("curve_id", "trade_date", F.inline("grid"))


def price_meetings(curves: DataFrame, meetings: DataFrame, mid: float, step_bp: float = 25.0) -> DataFrame:
    """What a curve's overnight rate from each meeting (meeting_date, not before the trade date) to the next business day implies for the policy rate.

    A trade date's meetings are found once and joined to its curves by the date, so that no curve is compared with all meetings.
    """
    m = meetings.select("meeting_date", dt.next_business_day(F.col("meeting_date")).alias("effective_date"))
    days = curves.select("trade_date").distinct().join(m, F.col("meeting_date") >= F.col("trade_date"))  # the calendar's days and meetings
    days = days.groupBy("trade_date").agg(F.collect_list(F.struct("meeting_date", "effective_date")).alias("ahead"))
    c = curves.where("status IS NULL").select("curve_id", "trade_date", "ts", "ls").join(days, "trade_date")
    c = c.select("curve_id", "trade_date", "ts", "ls", F.inline("ahead"))
    days, step = F.datediff("effective_date", "meeting_date"), step_bp / 10000
    at = lambda x: _df(F.col("ts"), F.col("ls"), dt.act_360(F.col("trade_date"), F.col(x)))
    c = c.withColumn("_r", (at("meeting_date") / at("effective_date") - 1) * 360 / days)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    b = lambda x, n: F.bround(x, n)
    return c.select("curve_id", "trade_date", "meeting_date", "effective_date", days.alias("window_days"), b(F.col("_r") * 100, 4).alias("implied_pct"), b((F.col("_r") - mid) * 10000, 2).alias("diff_bp"), b(unit((mid - F.col("_r")) / step) * 100, 1).alias("p_cut_pct"), b(unit((F.col("_r") - mid) / step) * 100, 1).alias("p_hike_pct"),
                    F.lit(round((mid - step) * 100, 4)).alias("rate_if_cut"), F.lit(round((mid + step) * 100, 4)).alias("rate_if_hike"), F.lit(round(mid * 100, 4)).alias("rate_if_hold"))


def compare_schedules(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two schedules (curve_id, coupon_no, coupon_date, alpha) by position: both dates, days apart, accruals apart in days, and whether they differ."""
    j = a.alias("a").join(b.alias("b"), ["curve_id", "coupon_no"], "full")
    days = F.datediff("b.coupon_date", "a.coupon_date")
    frac = F.bround((F.bround("b.alpha", 8) - F.bround("a.alpha", 8)) * 360, 6)
    return j.select("curve_id", "coupon_no", F.col("a.coupon_date").alias("date_a"), F.col("b.coupon_date").alias("date_b"), days.alias("days"), frac.alias("accrual_days"), (~(days.eqNullSafe(F.lit(0)) & frac.eqNullSafe(F.lit(0.0)))).alias("differs"))


def compare_pillars(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Maturities (mat) of two pillar tables by key: both, the days apart, and whether they differ."""
    j = a.select(*keys, F.col("mat").alias("mat_a")).join(b.select(*keys, F.col("mat").alias("mat_b")), keys)
    return j.withColumn("days", F.datediff("mat_b", "mat_a")).withColumn("differs", F.col("days") != 0)


def panel_of(maturity: Column, cutoff: Column) -> Column:
    """short up to the cutoff, long beyond."""
    return F.when(maturity <= cutoff, "short").otherwise("long")


def compare_rates(a: DataFrame, b: DataFrame, value: str, keys: list[str]) -> DataFrame:
    j = a.select(*keys, F.col(value).alias("rate_a")).join(b.select(*keys, F.col(value).alias("rate_b")), keys)
    return j.withColumn("diff_bp", (F.col("rate_b") - F.col("rate_a")) * 100)


def compare_grids(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """compare_rates of a value of two tables of grids by curve and tenor; curves are joined whole, a row each, and their tenors after."""
    own = lambda d, name: d.select("curve_id", "trade_date", F.transform("grid", lambda x: F.struct(x["tenor"].alias("tenor"), x[value].alias("rate"))).alias(name))
    j = own(a, "_a").join(own(b, "_b"), ["curve_id", "trade_date"])  # a trade date's grids are in the same order
    j = j.select("curve_id", "trade_date", F.inline(F.zip_with("_a", "_b", lambda x, y: F.struct(x["tenor"].alias("tenor"), x["rate"].alias("rate_a"), y["rate"].alias("rate_b")))))
    return j.withColumn("diff_bp", (F.col("rate_b") - F.col("rate_a")) * 100)


def comparison_summary(diffs: DataFrame, by: list[str], value: str = "diff_bp", tolerance: float = 1e-6) -> DataFrame:
    d = F.abs(value)
    return diffs.groupBy(*by).agg(F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.count_if(d > tolerance).alias("mismatches"), F.count("*").alias("n"))
