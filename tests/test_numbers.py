"""Closed forms, invariants and small literal cases."""

import datetime as d
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelark.functions import dates as dt
from tidelark.functions import numeric as nm
from tidelark.operators import curves, panel, policy, portfolio
from tidelark.sources import ingest


def cdf(x):
    return math.erfc(-x / math.sqrt(2)) / 2


def test_normal_distribution(spark):
    xs = [float(x) for x in np.linspace(-40, 40, 801)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", nm.norm_cdf(F.col("x")).alias("c")).collect()
    assert max(abs(r.c - cdf(r.x)) for r in rows) < 1e-15


def test_options(spark):
    rows = [(160.0, 150.0, 30 / 365, 0.02, 0.35, 0.0, True, False), (61.37, 90.0, 47 / 365, 0.04125, 0.5225, 0.0, True, True), (1.3447, 1.295, 64 / 365, 0.042, 0.083, 0.0, False, True), (100.0, 90.0, 0.0, 0.04, 0.2, 0.0, True, False), (100.0, 90.0, 1.0, 0.04, 0.0, 0.01, True, False), (100.0, 120.0, 1.0, 0.04, 0.0, 0.0, False, True)]
    df = spark.createDataFrame(rows, "s double, k double, t double, r double, v double, q double, c boolean, f boolean")
    priced = lambda x: nm.price_options(x, *(F.col(n) for n in ("s", "k", "t", "r", "v", "q", "c", "f"))).collect()
    out = priced(df)
    for row, o in zip(rows, out, strict=True):
        s, k, t, r, v, q, call, fwd = row
        w, b = (1 if call else -1), (0 if fwd else r - q)
        if t > 0 and v > 0:
            d1 = (math.log(s / k) + (b + v * v / 2) * t) / (v * math.sqrt(t))
            want = w * (s * math.exp((b - r) * t) * cdf(w * d1) - k * math.exp(-r * t) * cdf(w * (d1 - v * math.sqrt(t))))
        else:
            want = max(w * (s * math.exp((b - r) * t) - k * math.exp(-r * t)), 0) if t > 0 else max(w * (s - k), 0)
        assert o.price == pytest.approx(want, abs=1e-12)
        assert (t > 0 and v > 0) or (o.gamma, o.vega, o.theta, o.rho) == (0, 0, 0, 0)
    h = 1e-5
    up, down = priced(df.withColumn("s", F.col("s") + h)), priced(df.withColumn("s", F.col("s") - h))
    later = priced(df.withColumn("t", F.greatest(F.col("t") - h, F.lit(0.0))))
    for o, u, l, t in list(zip(out, up, down, later, strict=True))[:3]:
        assert o.delta == pytest.approx((u.price - l.price) / (2 * h), abs=1e-6)
        assert o.theta == pytest.approx((t.price - o.price) / h, rel=1e-3, abs=1e-4)
    both = priced(df.limit(1).withColumn("c", F.lit(False)).unionByName(df.limit(1)))
    assert both[1].price - both[0].price == pytest.approx(160 - 150 * math.exp(-0.02 * 30 / 365), abs=1e-10)


def test_ticks_and_keys(spark):
    r = spark.range(1).select(
        nm.tick_round(F.lit(1.005), F.lit(0.01)).alias("a"), nm.tick_round(F.lit(-0.125), F.lit(0.25)).alias("b"), nm.tick_round(F.lit(3.3), F.lit(0.0)).alias("c"), nm.at_least_a_tick(F.lit(-0.001), F.lit(0.25)).alias("d"),
        nm.option_key(F.lit("ES"), F.to_date(F.lit("2026-03-20")), F.lit(90.0), F.lit(True)).alias("e"), nm.option_key(F.lit("ES"), F.to_date(F.lit("2026-03-20")), F.lit(90.5), F.lit(False)).alias("f"),
        nm.mixed_fraction(F.lit("3 7/8")).alias("g"), nm.mixed_fraction(F.lit("7/8")).alias("h"), nm.mixed_fraction(F.lit("x")).alias("i"), nm.mixed_fraction(F.lit("4")).alias("j"),
        nm.tick_round(F.lit(1e11), F.lit(0.25)).alias("k"), nm.tick_round(F.lit(-123456789012.3), F.lit(0.25)).alias("l"), nm.tick_round(F.lit(float("inf")), F.lit(0.25)).alias("m"), nm.tick_round(F.lit(None).cast("double"), F.lit(0.25)).alias("n"), nm.tick_round(F.lit(1e300), F.lit(0.01)).alias("o"),
    ).first()
    assert tuple(r)[:14] == (1.01, -0.25, 3.3, -0.25, "ES_MAR26_90C", "ES_MAR26_90.5P", 3.875, 0.875, None, 4.0, 1e11, -123456789012.25, math.inf, None) and r.o == pytest.approx(1e300)


def test_ticks_as_decimal_digits_say(spark):
    from decimal import ROUND_HALF_UP, Decimal

    rng = np.random.default_rng(5)
    rows = [(float(round(x, int(k))), t) for x, k in zip(rng.uniform(-3000, 3000, 4000), rng.integers(0, 6, 4000), strict=True) for t in (0.01, 0.015625, 0.25, 0.005)]
    for r in spark.createDataFrame(rows, "v double, t double").select("v", "t", nm.tick_round(F.col("v"), F.col("t")).alias("r")).collect():
        assert r.r == pytest.approx(float((Decimal(str(r.v)) / Decimal(str(r.t))).to_integral_value(ROUND_HALF_UP) * Decimal(str(r.t))), abs=1e-9), r


def test_zero_rates_by_the_date(spark):
    one = lambda days: spark.range(1).select(nm.zero_rate(F.lit(0.95), F.lit(days / 360), F.lit(days) <= 365).alias("z")).first().z
    for days in (300, 361, 365):
        assert one(days) == pytest.approx(100 * (1 / 0.95 - 1) * 360 / days)
    for days in (366, 400):
        assert one(days) == pytest.approx(100 * (0.95 ** (-360 / days) - 1))


def test_contracts_by_rule(spark):
    f = spark.createDataFrame([("TYM6", "6M"), ("TYM6", "3M"), ("TYU6", "3M"), ("FV", "3M"), ("FVZ6", "3M"), ("FV", "1M"), ("US", "6M"), ("USX", "3M")], "px_ident string, maturity string")
    rules = spark.createDataFrame([("TY", "3M"), ("FV", "3M"), ("US", "3M"), ("XX", "3M")], "symbol string, maturity string")
    got = sorted((r.symbol, r.px_ident, r.maturity) for r in panel.select_contracts(f, rules).select("symbol", "px_ident", f.maturity).collect())
    assert got == [("FV", "FV", "3M"), ("TY", "TYM6", "3M"), ("TY", "TYU6", "3M"), ("US", "USX", "3M")]


def test_meeting_lines(spark):
    text = "x\n2026 FOMC Meetings\nJanuary\n27-28*\nStatement: 12\nAugust\n22 (notation vote)\n9-10 later\nabout 2027 FOMC Meetings\n2027 FOMC Meetings\n3\nJune\n15-16"
    got = [tuple(r) for r in ingest.rolling_meetings(spark.createDataFrame([("p", text)], "page string, text string")).collect()]
    assert sorted(got) == sorted([(2026, 1, 28), (2026, 8, 22), (2026, 8, 10), (2027, 8, 3), (2027, 6, 16)])


def test_calendar(spark):
    cal = {r.d: r for r in dt.business_calendar(spark, 2025, 2027).collect()}
    assert cal[d.date(2026, 7, 2)].next_bd == d.date(2026, 7, 6)  # the 4th is a Saturday, kept on Friday
    assert not cal[d.date(2026, 6, 19)].is_bd and not cal[d.date(2026, 11, 26)].is_bd
    assert cal[d.date(2026, 5, 31)].mf == d.date(2026, 5, 29)
    every = {r.d: r for r in dt.business_calendar(spark, 1999, 2101).collect()}
    held = {r.holiday for r in dt.us_holidays(spark, 1998, 2102).collect()}
    days = sorted(every)
    assert all(every[x].is_bd == (x.weekday() < 5 and x not in held) for x in days)
    open_ = [x for x in days if every[x].is_bd]
    after = dict(zip(open_, open_[1:], strict=False))
    assert all(every[x].next_bd == y and every[y].prev_bd == x for x, y in after.items())
    far = spark.range(1).select(dt.next_business_day(F.to_date(F.lit("2433-07-03"))).alias("a"), dt.add_tenor(F.to_date(F.lit("1850-01-31")), F.lit("1M")).alias("b")).first()
    assert (far.a, far.b) == (d.date(2433, 7, 5), d.date(1850, 2, 28))
    s = spark.range(1).select(dt.backward_schedule(F.to_date(F.lit("2027-08-31")), F.to_date(F.lit("2026-02-12"))).alias("s")).first().s
    assert s == [d.date(2026, 2, 28), d.date(2026, 8, 28), d.date(2027, 2, 28), d.date(2027, 8, 31)]
    f = spark.range(1).select(dt.futures_dates(F.lit("SOFR3H6"), F.to_date(F.lit("2026-02-23"))).alias("a"), dt.futures_dates(F.lit("SOFR3H5"), F.to_date(F.lit("2026-02-23"))).alias("b"), dt.futures_dates(F.lit("xx"), F.to_date(F.lit("2026-02-23"))).alias("c")).first()
    assert (f.a.start, f.a.end) == (d.date(2026, 3, 18), d.date(2026, 6, 17)) and f.b.start == d.date(2035, 3, 21) and f.c is None


def quotes(spark, up=0.0):
    rows = [(1, "ON", "1B", "Rate", 3.6), (1, "SOFR3Z5", "3M", "Future", 96.38), (1, "SOFR3H6", "3M", "Future", 96.4), (1, "SOFR3M6", "3M", "Future", 96.5), (1, "2Y", "2Y", "Swap", 3.5), (1, "3Y", "3Y", "Swap", 3.5), (1, "4Y", "4Y", "Swap", 3.55 + up), (1, "5Y", "5Y", "Swap", 3.6), (1, "?", "1Y", "Other", 1.0), (2, "ON", "1B", "Rate", 3.6), (2, "2Y", "2Y", "Swap", -30.0), (3, "ON", "1B", None, 3.6)]
    return spark.createDataFrame(rows, "curve_id int, symbol string, tenor string, type string, quote double").withColumn("trade_date", F.to_date(F.lit("2026-02-23")))


def no_params(spark):
    return spark.createDataFrame([], "curve_id int, trade_date date, hw_a double, hw_sigma double")


def test_bootstrap_against_plain_python(spark):
    rows = curves.curve_rows(quotes(spark), no_params(spark))
    solved = {r.curve_id: r for r in curves.bootstrap(rows).collect()}
    assert 3 not in solved and "increases" in solved[2].status
    ts, ls = [0.0], [0.0]

    def at(t):
        if len(ts) == 1:
            return math.exp(ls[0])
        k = max(1, min(len(ts) - 1, sum(x < t for x in ts)))
        return math.exp(ls[k - 1] + (ls[k] - ls[k - 1]) * (t - ts[k - 1]) / (ts[k] - ts[k - 1]))

    a, sg = 0.03, 0.006
    for x in solved[1].xs:
        r = x.quote / 100
        if x.type == "Rate":
            df = 1 / (1 + r * x.t)
        elif x.type == "Future":
            t1 = max(x.t1, 0)
            b = lambda p, q: (1 - math.exp(-a * (q - p))) / a
            ca = sg * sg / 2 * b(t1, x.t) * (b(0, x.t) * math.exp(-a * x.t) + (1 - math.exp(-2 * a * t1)) / (2 * a))
            df = at(t1) / (1 + ((100 - x.quote) / 100 - ca) * x.alpha)
        else:
            paid = sum(c.alpha * at(c.t) for c in x.coupons[:-1])
            df = (at(x.te) - r * paid) / (1 + r * x.coupons[-1].alpha)
        ts.append(x.t)
        ls.append(math.log(df))
    assert solved[1].ts == pytest.approx(ts, abs=1e-14) and solved[1].ls == pytest.approx(ls, abs=1e-14)
    p = {r.symbol: r for r in curves.pillars(curves.bootstrap(rows)).collect()}
    assert max(abs(p[s].error_bp) for s in ("ON", "SOFR3Z5", "SOFR3M6", "3Y", "4Y", "5Y")) < 1e-6  # what lies between pillars was extrapolated for the others
    q = curves.fit_quality(curves.bootstrap(rows)).first()
    assert q.pillars == 8 and q.min_forward > -0.05
    b = {r.symbol: r.dv01 for r in curves.bucket_dv01(rows, 1.0).where("curve_id = 1").collect()}
    moved = curves.bootstrap(curves.curve_rows(quotes(spark, 0.01), no_params(spark))).where("curve_id = 1").first()
    assert b["4Y"] == pytest.approx(sum(math.exp(y) - math.exp(x) for x, y in zip(ls, moved.ls, strict=True)), abs=1e-8) and len(b) == 8
    g = {r.tenor: r for r in curves.reprice_grid(curves.bootstrap(rows)).where("curve_id = 1").collect()}
    assert len(g) == 28 and g["5Y"].par == pytest.approx(3.6, abs=1e-9)
    m = spark.createDataFrame([("2026-03-18",), ("2020-01-01",)], "s string").select(F.to_date("s").alias("meeting_date"))
    priced = curves.price_meetings(curves.bootstrap(rows), m, 0.03625).collect()
    assert len(priced) == 1 and priced[0].rate_if_cut == 3.375 and 0 <= priced[0].p_cut_pct <= 100


def test_policy_and_yields(spark):
    base = spark.createDataFrame([(1, 0.03625)], "base_id int, initial_rate double")
    s = policy.scenarios(base, ["2026-03-18", "2026-04-29", "2026-06-17"], [-1, 0, 1], max_cuts=1, max_hikes=0)
    got = {int(r.scenario_id): r.cut_dates for r in s.collect()}
    assert got == {13: None, 12: "2026-06-17", 10: "2026-04-29", 4: "2026-03-18"}
    bonds = spark.createDataFrame([(7, 0.035)], "bond_id int, coupon double").withColumn("maturity", F.to_date(F.lit("2028-01-31")))
    paths = policy.daily_paths(s, "2026-02-23", 728, 0.0025, base=364.0, hikes=False)
    out = {int(r.scenario_id): r for r in policy.price_bonds(paths, bonds, "2026-02-12", 364.0).collect()}
    day = [math.exp(-sum(math.log(1 + (0.03625 - 0.0025 * (d.date(2026, 2, 23) + d.timedelta(j) >= d.date(2026, 4, 29))) / 364) for j in range(1, k + 1))) for k in range(1, 729)]
    dates = [d.date(2026, 7, 31), d.date(2027, 1, 31), d.date(2027, 7, 31), d.date(2028, 1, 31)]
    pv = sum((1.75 + 100 * (x == dates[-1])) * np.interp((x - d.date(2026, 2, 12)).days / 365, [k / 364 for k in range(1, 729)], day) for x in dates)
    assert out[10].dirty == pytest.approx(pv, abs=1e-9)
    y = out[10].ytm
    assert sum(1.75 / (1 + y / 2) ** i for i in range(1, 5)) + 100 / (1 + y / 2) ** 4 == pytest.approx(out[10].dirty, abs=1e-9)
    a = {int(r.scenario_id): r.accum for r in policy.accumulation(paths, 364.0).collect()}
    assert a[10] == pytest.approx(1 / day[-1], rel=1e-12)


def test_weights_and_risk(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 4)) @ rng.standard_normal((4, 4))
    rows = [(d.date(2025, 1, 1) + d.timedelta(i), f"S{j}", float(x[i, j])) for i in range(300) for j in range(4)]
    rets = spark.createDataFrame(rows, "date date, symbol string, ret double")
    cov = panel.rolling_covariance(rets, 126)
    w = panel.min_variance_weights(cov)
    one = {r.symbol: r.weight for r in w.where("date = '2025-05-06'").collect()}
    c = np.cov(x[:126].T)
    want = np.linalg.solve(c, np.ones(4))
    want /= want.sum()
    assert [one[f"S{j}"] for j in range(4)] == pytest.approx(list(want), rel=1e-9)
    r = panel.risk_contributions(cov, w).groupBy("date").agg(F.sum("contribution").alias("c"), F.max("total").alias("t"), F.sum("weight").alias("w")).collect()
    assert all(abs(z.c - z.t) < 1e-10 and abs(z.w - 1) < 1e-10 for z in r) and len(r) == 175
    flat = spark.createDataFrame([(d.date(2025, 1, 1), a, b, 1.0) for a, b in (("A", "A"), ("A", "B"), ("B", "B"))], "date date, sym_i string, sym_j string, cov double")
    assert all(z.weight is None for z in panel.min_variance_weights(flat).collect())


def test_updates_are_applied_in_order(spark):
    p = spark.createDataFrame([(1, "A", "option", 5, 1.0, None), (2, "A", "future", 6, 2.0, None)], "pos_no int, symbol string, type string, expiry_days int, trade_price double, q double")
    u = spark.createDataFrame([(1, "A", None, 9, None, None), (2, "A", "option", 7, 1.0, None), (3, "Z", None, 1, None, None), (4, "A", "future", 6, None, None)], "seq int, symbol string, type string, expiry_days int, trade_price double, q double")
    out, report = portfolio.update_positions(p, u)
    assert {r.pos_no: (r.expiry_days, r.trade_price) for r in out.collect()} == {1: (7, 1.0), 2: (6, 2.0)}
    r = {x.seq: x for x in report.collect()}
    assert [r[i].status for i in (1, 2, 3, 4)] == ["changed", "changed", "not_found", "none"] and r[2].changes[0].old == "9"


def test_bar_store(spark, tmp_path):
    import json

    from tidelark.streaming import candles

    land, store = tmp_path / "land", str(tmp_path / "bars")
    land.mkdir()
    bar = lambda day, close: {"datetime": 1704067200000 + day * 86400000, "open": 1.0, "high": 2.0, "low": 0.5, "close": close, "volume": 3}
    (land / "a.json").write_text(json.dumps({"symbol": "ES", "candles": [bar(0, 1.5), bar(1, 1.6)]}))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    for _ in range(2):
        q = candles.store_candles(candles.candle_stream(spark, str(land)), store, str(tmp_path / "ck"), once=True)
        q.awaitTermination()
        (land / "b.json").write_text(json.dumps({"symbol": "ES", "candles": [bar(1, 9.9), bar(2, 1.7)]}))
    got = {str(r.dt)[:10]: r.close for r in ingest.read_bars(spark, store, "ES").collect()}
    assert got == {"2024-01-01": 1.5, "2024-01-02": 1.6, "2024-01-03": 1.7}
    gaps = ingest.coverage_gaps(spark.createDataFrame([("ES",), ("NQ",)], "symbol string"), ingest.read_bars(spark, store), "2023-12-30", "2024-01-04").collect()
    assert sorted((g.symbol, str(g.begin), str(g.finish)) for g in gaps) == [("ES", "2023-12-30", "2023-12-31"), ("NQ", "2023-12-30", "2024-01-04")]


def test_file_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("trading_date,ric,last,volume\n2024-01-02,AAA.N,1.5,10\n")
    (tmp_path / "specs.json").write_text('{"ES": {"multiplier": 50, "tick_size": 0.25, "tick_value": 12.5, "asset_class": "Index"}}')
    (tmp_path / "sym.txt").write_text("# c\n\nES,/ES,first\nES,/ESZ,second, part\nbad\n")
    assert ingest.read_equities(spark, str(tmp_path / "e.csv")).first().ric == "AAA"
    assert ingest.read_specs(spark, str(tmp_path / "specs.json")).first().multiplier == 50.0
    assert [tuple(r) for r in ingest.read_symbols(spark, str(tmp_path / "sym.txt")).collect()] == [("ES", "/ESZ", "second, part")]


def test_updates_meet_one_position_each(spark):
    p = spark.createDataFrame([(i, f"S{i % 3}" if i % 7 else None, "OF"[i // 3 % 2] if i % 5 else None, i, 0.0, 0.0) for i in range(1, 60)], "pos_no int, symbol string, type string, expiry_days int, trade_price double, q double")
    u = spark.createDataFrame([(i, f"S{i % 4}", (None, "O", "F", "X")[i // 4 % 4], 100 + i, None, None) for i in range(64)], "seq int, symbol string, type string, expiry_days int, trade_price double, q double")
    out, report = portfolio.update_positions(p, u)
    now = {r.pos_no: r.expiry_days for r in p.collect()}
    want = {}
    for r in sorted(u.collect()):
        hit = min((x.pos_no for x in p.collect() if x.symbol == r.symbol and (r.type is None or x.type == r.type)), default=None)
        want[r.seq] = None if hit is None else now[hit]
        now[hit] = r.expiry_days
    assert {r.seq: r.changes and int(r.changes[0].old) for r in report.collect()} == want
    assert {r.pos_no: r.expiry_days for r in out.collect()} == {k: v for k, v in now.items() if k}
    assert " OR " not in report._jdf.queryExecution().optimizedPlan().toString()  # a join on equal keys, not all pairs of a symbol


def test_schedules_of_any_length(spark):
    day = lambda x: F.to_date(F.lit(x))
    s = spark.range(1).select(dt.backward_schedule(day("2126-02-15"), day("2026-02-12")).alias("s")).first().s
    assert len(s) == 201 and s[0] == d.date(2026, 2, 15) and s[-1] == d.date(2126, 2, 15)
    s = spark.range(1).select(dt.backward_schedule(day("2026-02-12"), day("2026-02-12")).alias("a"), dt.backward_schedule(day("2026-02-13"), day("2026-02-12")).alias("b")).first()
    assert s.a == [] and s.b == [d.date(2026, 2, 13)]
    b = spark.range(1).select(day("1990-01-03").alias("eff"), day("2070-01-03").alias("mat"))
    rows = sorted(dt.annual_schedule(b, "eff", "mat").select("coupon_no", "coupon_date").collect())
    assert [r.coupon_no for r in rows] == list(range(1, len(rows) + 1)) and len(rows) >= 80 and rows[-1].coupon_date == d.date(2070, 1, 3)


def test_every_part_is_priced(spark, tmp_path):
    from tidelark.plans import rates

    spark.createDataFrame([(i, 5 + i, 900.0) for i in range(1, 5)], "p_partkey bigint, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0,)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    rows = rates.Q["c9_scenario_bonds"](spark, str(tmp_path)).select("bond_id").distinct().collect()
    assert sorted(r.bond_id for r in rows) == [1, 2, 3, 4]
