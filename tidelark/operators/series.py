"""Long series in blocks: rolling windows, lags and exponentially weighted variances whose series are split over tasks.

A series' rows are numbered by counts of time buckets, and cut into blocks of as many rows each. What a window needs of the
rows before its block, the halo, is copied into the block; what a recursion needs is the block's summary, which is carried
from block to block. One series of any length is so the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Days of a time bucket, and rows of a block, which must be as many as a window has at least.
DAYS, ROWS = 128, 4096


def numbered(df: DataFrame, by: list[str], date: str = "date", days: int = DAYS) -> DataFrame:
    """df with pos, the row's place from 0 in its series by date. Rows are numbered within buckets of days; the counts of the buckets before, a row a bucket, are added."""
    d = df.withColumn("_bucket", F.floor(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) / days))
    keys = [*by, "_bucket"]
    w = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*keys).agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(date)))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    out = d.alias("d").join(counts.alias("c"), same)
    return out.select(*(F.col(f"d.{c}") for c in df.columns), (F.col("_before") + F.col("_i") - 1).alias("pos"))


def in_blocks(df: DataFrame, reach: int, rows: int = ROWS) -> DataFrame:
    """df (pos) with _block and _own: each row in its block and, if it is one of the last `reach`, as a row of the halo (_own false) in the next."""
    if not 0 <= reach <= rows:
        raise ValueError("a window must fit in a block")
    block = F.floor(F.col("pos") / rows)
    places = F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own")))
    some = F.when(F.col("pos") % rows >= rows - reach, places).otherwise(F.slice(places, 1, 1)) if reach else F.slice(places, 1, 1)
    return df.select("*", F.explode(some).alias("_p")).select(*df.columns, F.col("_p.b").alias("_block"), F.col("_p.own").alias("_own"))


def rolling(df: DataFrame, by: list[str], reach: int, columns: dict[str, Callable[[WindowSpec], Column]], date: str = "date", rows: int = ROWS) -> DataFrame:
    """df with pos and columns: functions of the window (by series and block, in order) that look back `reach` rows at most."""
    d = in_blocks(numbered(df, by, date), reach, rows)
    w = Window.partitionBy(*by, "_block").orderBy("pos")
    return d.withColumns({n: f(w) for n, f in columns.items()}).where("_own").drop("_own", "_block")


def full(value: Callable[[WindowSpec], Column], window: int) -> Callable[[WindowSpec], Column]:
    """The value over the last `window` rows of a series; NULL where there are fewer."""
    return lambda w: F.when(F.col("pos") >= window - 1, value(w.rowsBetween(1 - window, 0)))


def log_changes(prices: DataFrame, by: str = "symbol", rows: int = ROWS) -> DataFrame:
    """(by, date, ret) of prices that aren't NULL; the first of a series has none."""
    d = rolling(prices.where("price IS NOT NULL"), [by], 1, {"ret": lambda w: F.ln("price") - F.lag(F.ln("price")).over(w)}, rows=rows)
    return d.where("pos > 0").select(by, "date", "ret")


def interpolate_in_time(df: DataFrame, value: str, by: str = "symbol", rows: int = ROWS) -> DataFrame:
    """df with gaps of value filled linearly in elapsed days; leading gaps stay, trailing ones repeat the last value.

    The nearest known values are looked for in a row's block; where it has none, in the blocks around, by their first and last known.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("date").alias("d"), F.col(value).alias("x")))
    d = in_blocks(numbered(df, [by]), 0, rows).drop("_own")
    w = Window.partitionBy(by, "_block").orderBy("pos")
    to, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    edges = d.groupBy(by, "_block").agg(F.min(known).alias("first"), F.max(known).alias("last"))
    blocks = Window.partitionBy(by).orderBy("_block")  # a row a block
    edges = edges.select(by, "_block", F.last("last", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_pa"), F.first("first", ignorenulls=True).over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("_pz"))
    d = d.withColumns({"_a": F.last(known, ignorenulls=True).over(to), "_z": F.first(known, ignorenulls=True).over(on)}).join(edges, [by, "_block"])
    d = d.withColumns({"_a": F.coalesce("_a", "_pa"), "_z": F.coalesce("_z", "_pz")})
    line = F.col("_a.x") + F.try_divide((F.col("_z.x") - F.col("_a.x")) * F.datediff("date", "_a.d"), F.datediff("_z.d", "_a.d"))
    filled = F.coalesce(F.col(value), F.when(F.col("_a").isNotNull() & F.col("_z").isNotNull(), line), F.col("_a.x"))
    return d.withColumn(value, filled).select(*df.columns)


def _decayed_sums(x: np.ndarray, keep: float) -> np.ndarray:
    """Of each place, the sum of the values up to it, each times keep to the power of its distance: a scan in steps that double."""
    out, k = x.copy(), 1
    while k < len(out):
        out[k:] = out[k:] + keep**k * out[:-k]
        k *= 2
    return out


def _block_states(batches: Iterator[pa.RecordBatch], keep: float) -> Iterator[pa.RecordBatch]:
    """Rows (symbol, date, _block, ret), in order, with what the block's rows up to each sum to: n, mean and variance by weight; last marks a block's end."""
    names = ["symbol", "date", "_block", "n", "mean", "var", "last"]
    held: list[pa.RecordBatch] = []

    def scanned(t: pa.Table, closed: bool) -> Iterator[pa.RecordBatch]:
        """Whole blocks of t; returns what is left by putting it into held."""
        keys = pa.chunked_array([t.column("symbol").combine_chunks().dictionary_encode().indices.cast(pa.int64())]).to_numpy(), t.column("_block").to_numpy()
        ends = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
        bounds = [0, *ends.tolist(), len(t)]
        whole = bounds if closed else bounds[:-1]
        x = t.column("ret").to_numpy()
        for a, z in zip(whole, whole[1:], strict=False):
            part = x[a:z]
            middle = float(part.mean())
            w = _decayed_sums(np.ones(z - a), keep)
            m = _decayed_sums(part - middle, keep) / w
            v = np.maximum(_decayed_sums((part - middle) ** 2, keep) / w - m * m, 0.0)
            n = np.arange(1, z - a + 1)
            cut = t.slice(a, z - a).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(cut.column(c).combine_chunks() for c in ("symbol", "date", "_block")), pa.array(n), pa.array(m + middle), pa.array(v), pa.array(n == z - a)], names)
        held.clear()
        if not closed and whole[-1] < len(t):
            held.extend(t.slice(whole[-1]).to_batches())

    for b in batches:
        held.append(b)
        if sum(len(h) for h in held) >= 2 * ROWS:
            yield from scanned(pa.Table.from_batches(held), False)
    if held:
        yield from scanned(pa.Table.from_batches(held), True)


def _carried(batches: Iterator[pa.RecordBatch], keep: float) -> Iterator[pa.RecordBatch]:
    """Summaries (symbol, _block, n, mean, var) of blocks in order to (symbol, _block, c_n, c_mean, c_var), the rows before each block together."""
    symbol, state = None, (0, 0.0, 0.0)
    for b in batches:
        out = []
        for s, block, n, mean, var in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if s != symbol:
                symbol, state = s, (0, 0.0, 0.0)
            out.append((s, block, *state))
            wa, wb = _weight(state[0], keep) * keep**n, _weight(n, keep)
            m = (wa * state[1] + wb * mean) / (wa + wb)
            state = (state[0] + n, m, (wa * (state[2] + (state[1] - m) ** 2) + wb * (var + (mean - m) ** 2)) / (wa + wb))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (b.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["symbol", "_block", "c_n", "c_mean", "c_var"]) if out else b.slice(0, 0)


def _weight(n, keep: float):
    return (1 - keep**n) / (1 - keep)


def ewma_volatility(prices: DataFrame, span: int = 63, rows: int = ROWS) -> DataFrame:
    """(symbol, date, vol): annualised exponentially weighted volatility of log returns, bias-corrected; NULL for the first.

    Each block of a series is scanned by itself; a block's rows are then joined to the state of all rows before the block.
    """
    keep = 1 - 2 / (span + 1)
    kinds = dict(prices.dtypes)
    r = in_blocks(numbered(log_changes(prices, rows=rows), ["symbol"]), 0, rows).select("symbol", "date", "_block", "ret", "pos")
    r = r.repartition("symbol", "_block").sortWithinPartitions("symbol", "_block", "pos").drop("pos")
    schema = f"symbol {kinds['symbol']}, date {kinds['date']}, _block bigint, n bigint, mean double, var double, last boolean"
    local = r.mapInArrow(lambda b: _block_states(b, keep), schema)
    ends = local.where("last").select("symbol", "_block", "n", "mean", "var").repartition("symbol").sortWithinPartitions("symbol", "_block")
    before = ends.mapInArrow(lambda b: _carried(b, keep), f"symbol {kinds['symbol']}, _block bigint, c_n bigint, c_mean double, c_var double")
    d = local.join(before, ["symbol", "_block"])
    power = F.pow(F.lit(keep), F.col("n"))
    wb, wa = (1 - power) / (1 - keep), (1 - F.pow(F.lit(keep), F.col("c_n"))) / (1 - keep) * power
    n = F.col("n") + F.col("c_n")
    d = d.withColumns({"_wa": wa, "_wb": wb, "_w2": (1 - F.pow(F.lit(keep * keep), n)) / (1 - keep * keep)}).withColumn("_w", F.col("_wa") + F.col("_wb"))
    apart = F.col("mean") - F.col("c_mean")
    var = (F.col("_wa") * F.col("c_var") + F.col("_wb") * F.col("var")) / F.col("_w") + F.col("_wa") * F.col("_wb") * apart * apart / (F.col("_w") * F.col("_w"))
    vol = F.sqrt(var * F.col("_w") * F.col("_w") / (F.col("_w") * F.col("_w") - F.col("_w2")) * 252)
    return d.select("symbol", "date", F.when(n > 1, vol).alias("vol"))
