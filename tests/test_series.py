"""Long series in blocks, tails of distributions and exact quantiles, against plain Python."""

import datetime as d
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelark.functions import stats
from tidelark.operators import panel, series

DAY = d.date(2020, 1, 1)


@pytest.fixture(scope="module")
def walk(spark):
    """Two series, one of 500 days and one of 7 with gaps, and their prices."""
    rng = np.random.default_rng(4)
    days = {"A": [DAY + d.timedelta(int(k)) for k in np.cumsum(rng.integers(1, 5, 500))], "B": [DAY + d.timedelta(400 * k) for k in range(7)]}
    values = {s: np.exp(np.cumsum(rng.normal(0, 0.02, len(x)))) for s, x in days.items()}
    rows = [(s, t, float(v)) for s in days for t, v in zip(days[s], values[s], strict=True)]
    return days, values, spark.createDataFrame(rows, "symbol string, date date, price double").repartition(5)


def test_places_and_halos(spark, walk):
    days, _, df = walk
    rows = series.numbered(df, ["symbol"]).collect()
    assert {(r.symbol, r.date): r.pos for r in rows} == {(s, t): i for s, x in days.items() for i, t in enumerate(x)}
    got = series.rolling(df, ["symbol"], 9, {"n": lambda w: F.count("*").over(w.rowsBetween(-9, 0))}, rows=16).collect()
    assert len(got) == 507 and all(r.n == min(r.pos + 1, 10) for r in got)
    tasks = series.in_blocks(series.numbered(df, ["symbol"]), 9, 16).where("symbol = 'A'").groupBy("_block").count().collect()
    assert len(tasks) == 32 and max(r["count"] for r in tasks) == 25  # one series, many blocks
    with pytest.raises(ValueError, match="fit"):
        series.in_blocks(df, 17, 16)
    assert series.rolling(df.where("false"), ["symbol"], 9, {"n": lambda w: F.count("*").over(w)}).collect() == []


def test_ewma_over_blocks(spark, walk):
    days, values, df = walk
    keep = 1 - 2 / 64
    want = {}
    for s, x in days.items():
        ret = np.diff(np.log(values[s]))
        for i in range(len(ret)):
            w = keep ** np.arange(i, -1, -1.0)
            m = (w * ret[: i + 1]).sum() / w.sum()
            v = (w * (ret[: i + 1] - m) ** 2).sum() / w.sum()
            want[s, x[i + 1]] = math.sqrt(v * w.sum() ** 2 / (w.sum() ** 2 - (w * w).sum()) * 252) if i else None
    for rows in (8, 64, 4096):
        got = {(r.symbol, r.date): r.vol for r in series.ewma_volatility(df, rows=rows).collect()}
        assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or got[k] == pytest.approx(want[k], rel=1e-9)) for k in want)
    assert series.ewma_volatility(df.where("false")).collect() == []


def test_rolling_slopes_over_blocks(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([(1, DAY + d.timedelta(i), float(x[i]), float(y[i])) for i in range(300)], "study int, date date, x double, y double")
    got = {(r.date - DAY).days: r.beta for r in panel.rolling_slope(df, "y", "x", ["study"], 64).collect()}
    assert all(got[i] is None for i in range(63)) and all(got[i] == pytest.approx(np.polyfit(x[i - 63 : i + 1], y[i - 63 : i + 1], 1)[0]) for i in range(63, 300))


def test_gaps_over_blocks(spark):
    known = {3: 1.0, 4: 5.0, 40: 9.0, 41: 3.0}
    df = spark.createDataFrame([("A", DAY + d.timedelta(2 * i), known.get(i)) for i in range(50)], "symbol string, date date, price double")
    want = [None if i < 3 else float(np.interp(i, list(known), list(known.values()))) for i in range(50)]
    for rows in (8, 4096):
        got = [r.price for r in series.interpolate_in_time(df, "price", rows=rows).orderBy("date").collect()]
        assert got == [None if w is None else pytest.approx(w) for w in want]


def test_tails(spark):
    #: Values of the t and F distributions from printed tables, and closed forms of one and two degrees of freedom.
    rows = [(2.228138851964939, 10.0, 0.05), (12.706204736432095, 1.0, 0.05), (1.0, 1.0, 0.5), (0.0, 7.0, 1.0), (1.96, 1e5, math.erfc(1.96 / math.sqrt(2)) + math.exp(-1.96**2 / 2) / math.sqrt(2 * math.pi) * (1.96**3 + 1.96) / 2e5), (1.96, 900.0, math.erfc(1.96 / math.sqrt(2)) + math.exp(-1.96**2 / 2) / math.sqrt(2 * math.pi) * ((1.96**3 + 1.96) / 1800)), (-2.0, 2.0, 1 - 2 / math.sqrt(6)), (40.0, 300.0, 0.0)]
    got = spark.createDataFrame(rows, "t double, v double, p double").select("p", stats.t_tails(F.col("t"), F.col("v")).alias("got"), stats.f_tail(F.col("t") * F.col("t"), F.lit(1), F.col("v")).alias("f")).collect()
    for r, (_, v, p) in zip(got, rows, strict=True):
        assert r.got == pytest.approx(p, abs=2e-6 if v == 900 else 1e-9) and r.f == pytest.approx(r.got, abs=1e-12)  # the expansion of 900 ends early
    f = spark.range(1).select(stats.f_tail(F.lit(3.0), F.lit(2), F.lit(10)).alias("a"), stats.t_tails(F.lit(1.0), F.lit(0)).alias("b")).first()
    assert f.a == pytest.approx((1 + 2 * 3 / 10) ** -5, abs=1e-12) and f.b is None  # two and n degrees of freedom: a closed form


def test_exact_quantiles(spark):
    rng = np.random.default_rng(8)
    groups = {1: rng.normal(size=5000), 2: np.r_[np.zeros(4000), 1e12, -5.0, rng.uniform(0, 1e-9, 900)], 3: np.array([7.0]), 4: np.array([1.0, 2.0]), 5: rng.integers(0, 3, 1000).astype(float)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [(6, None)], "g int, v double").repartition(4)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for rounds in (1, 2):
        got = {r.g: r.q for r in stats.exact_quantiles(df, "v", ["g"], shares, rounds).collect()}
        assert got.keys() == groups.keys()
        assert all(got[g] == pytest.approx(np.quantile(x, shares), rel=1e-12, abs=1e-15) for g, x in groups.items())


def test_many_studies(spark):
    rng = np.random.default_rng(6)
    price = {s: np.cumsum(rng.normal(0, 1, 40)) + 50 for s in "ABC"}
    rows = [(s, DAY + d.timedelta(i), None if (i + ord(s)) % 9 == 0 and i > 9 else float(price[s][i])) for s in "ABC" for i in range(40) if not (s == "C" and i == 20)]
    df = spark.createDataFrame(rows, "symbol string, date date, price double")
    st = spark.createDataFrame([("p", "A", "B", "C", "A", 10.0, 4.0, DAY + d.timedelta(15), 3.0, 21.0, 9.0, 1.5), ("q", "B", "C", "A", "A", 100.0, 0.0, None, 0.0, 1e9, 1e9, 1.5)], "study_id string, near string, far string, proxy_a string, proxy_b string, scale double, weight double, break_date date, break_shift double, clip_x double, clip_y double, band double")
    got = {(r.study_id, (r.date - DAY).days): r for r in panel.slope_studies(df, st).collect()}
    at = [i for i in range(40) if i != 20]
    fill = {s: np.interp(at, [i for i in at if not ((i + ord(s)) % 9 == 0 and i > 9)], [price[s][i] for i in at if not ((i + ord(s)) % 9 == 0 and i > 9)]) for s in "ABC"}
    dx = np.clip(np.diff(10 * (fill["B"] - fill["A"])), -21, 21)
    dy = np.clip(np.diff(fill["C"] + 4 * fill["A"] + 3 * (np.array(at) <= 15)), -9, 9)
    for k, i in enumerate(at[1:]):
        r = got["p", i]
        assert (r.x, r.y) == (pytest.approx(dx[k]), pytest.approx(dy[k])) and r.regime == ("Steepening" if dx[k] > 1.5 else "Flattening" if dx[k] < -1.5 else "Stable")
    assert len(got) == 2 * 38
    every = {r.study_id: r for r in panel.study_results(panel.slope_studies(df, st)).where("regime = 'All'").collect()}
    assert every["p"].n == 38 and every["p"].slope == pytest.approx(np.polyfit(dx, dy, 1)[0]) and every["p"].beta is None
