"""Books of positions by the rules of marks, risk steps and ladders, in plain Python; files and tables that must fail."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidelark.operators import panel, portfolio
from tidelark.sources import ingest


def cdf(x):
    return (1 + math.erf(x / math.sqrt(2))) / 2


def option(s, k, t, r, v, call, q=0.0, forward=False):
    """(price, delta, vega) by Black-Scholes, or Black on a forward."""
    b = 0.0 if forward else r - q
    d1 = (math.log(s / k) + (b + v * v / 2) * t) / (v * math.sqrt(t))
    d2, w = d1 - v * math.sqrt(t), 1 if call else -1
    grow = math.exp((b - r) * t)
    pdf = math.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)
    return w * (s * grow * cdf(w * d1) - k * math.exp(-r * t) * cdf(w * d2)), w * grow * cdf(w * d1), s * grow * pdf * math.sqrt(t)


COLUMNS = "book_id string, pos_no int, type string, symbol string, quantity double, trade_price double, strike double, expiry date, expiry_days int, option_type string, underlying_type string, underlying_symbol string, q double, vol double, rate double, open boolean"
#: Rows by number: an equity, a future, options with one thing missing each, and what isn't valued.
BOOK = [
    ("b", 1, "equity", "AAA", 10.0, None, None, None, None, None, None, None, None, None, None, None),
    ("b", 2, "future", "ESH26", -2.0, None, None, None, None, None, None, None, None, None, None, True),
    ("b", 3, "option", "AAAo", 3.0, 2.0, 105.0, None, 60, "call", "equity", "AAA", 0.01, 0.5, 0.02, None),
    ("b", 4, "option", "AAAp", 1.0, None, 95.0, None, None, "put", "equity", "AAA", None, None, None, None),  # no expiry, no entry, no volatility of its own
    ("b", 5, "option", "ESo", 1.0, 10.0, 4900.0, dt.date(2026, 4, 24), 5, "put", "future", "ESH26", None, 0.3, 0.09, None),  # a rate that doesn't hold for futures
    ("b", 6, "option", "XXo", 1.0, 10.0, 100.0, None, 30, "call", "future", "XXH26", None, 0.3, None, None),  # no tick for the root
    ("b", 7, "equity", "NOPE", 1.0, 5.0, None, None, None, None, None, None, None, None, None, None),
    ("b", 8, "swap", "AAA", 1.0, 5.0, None, None, None, None, None, None, None, None, None, None),
    ("b", 9, "equity", "AAA", 1.0, 5.0, None, None, None, None, None, None, None, None, None, False),
    ("b", 10, "equity", "NOPE", 4.0, 5.0, None, None, None, None, None, "AAA", None, None, None, None),  # priced by its underlying in ladders alone
]


@pytest.fixture(scope="module")
def resolved(spark):
    marks = spark.createDataFrame([("AAA", 100.0), ("ESH26", 5000.0), ("XXH26", 100.0)], "symbol string, price double")
    vols = spark.createDataFrame([("AAA", 0.4), ("ESo", 0.25)], "symbol string, vol double")
    specs = spark.createDataFrame([("ESH26", 50.0, 0.25, "Index"), ("ES", 7.0, 0.05, "Index")], "symbol string, multiplier double, tick_size double, asset_class string")
    given = spark.createDataFrame([("AAA_APR26_105C", 0.0), ("ESH26_APR26_4900P", 80.0)], "option_key string, unit_price double")
    return portfolio.resolve(spark.createDataFrame(BOOK, COLUMNS), marks, vols, specs, given, as_of="2026-02-23")


def test_marks(resolved):
    rows = {r.pos_no: r for r in portfolio.mark_to_market(resolved).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]
    assert (rows[1].market_value, rows[1].pnl, rows[1].greeks.delta, rows[1].greeks.vega, rows[1].asset_class) == (1000.0, None, 10.0, None, "Equity")
    assert (rows[2].market_value, rows[2].entry, rows[2].multiplier, rows[2].asset_class) == (0.0, 5000.0, 50.0, "Index")
    p, d, v = option(100, 105, 60 / 365, 0.02, 0.5, True, 0.01)  # the position's volatility before the underlying's
    assert rows[3].unit_price == pytest.approx(round(p, 2)) and rows[3].pnl == pytest.approx((round(p, 2) - 2) * 300) and rows[3].greeks.vega == pytest.approx(v * 300)
    assert rows[3].validation.mark == 0.0 and rows[3].validation.pct == math.inf and rows[3].delta_notional == pytest.approx(d * 300 * 100)
    p, *_ = option(100, 95, 30 / 365, 0.04, 0.2, False)
    assert rows[4].unit_price == pytest.approx(round(p, 2)) and rows[4].pnl is None and rows[4].market_value == pytest.approx(round(p, 2) * 100)
    p, d, _ = option(5000, 4900, 60 / 365, 0.04, 0.25, False, forward=True)  # the date before the days; the tick of the root; the underlying's multiplier
    assert rows[5].unit_price == pytest.approx(round(p / 0.05) * 0.05) and rows[5].greeks.delta == pytest.approx(d * 50)
    diff = round((rows[5].unit_price - 80) / 0.05) * 0.05
    assert rows[5].validation.diff == pytest.approx(diff) and rows[5].validation.pct == pytest.approx(100 * round(diff / 80, 4))
    assert rows[6].unit_price is None and rows[6].error and rows[1].error is None
    views = {(r.view, r.name): r.n for r in portfolio.views(portfolio.mark_to_market(resolved)).collect()}
    assert views["bucket", "EQUITY"] == 1 and views["bucket", "DERIVATIVE"] == 5 and views["asset_class", "Equity"] == 3
    again = {r.type: r for r in portfolio.reconcile(portfolio.mark_to_market(resolved)).collect()}
    assert all(r.mismatches == 0 for r in again.values()) and (again["option"].marks, again["option"].off_mark) == (2, 2)


def test_risk_steps(resolved):
    rows = {r.pos_no: r for r in portfolio.sensitivities(resolved).collect()}
    assert rows[1].base == pytest.approx(10.0) and rows[1].vol_1d == pytest.approx(10 * round(0.4 * 100 / math.sqrt(252), 2))
    assert rows[2].base == pytest.approx(50.0 * -2 * 50) and rows[2].vol_1d is None
    _, d, _ = option(100, 105, 60 / 365, 0.04, 0.4, True, 0.01)  # the underlying's volatility before the position's; not the position's rate
    assert rows[3].pct_linear == pytest.approx(d * 1.0 * 300)
    _, d, _ = option(5000, 4900, 5 / 365, 0.04, 0.25, False, forward=True)  # days before the date
    assert rows[5].pct_linear == pytest.approx(d * 50 * 50) and rows[5].day_step == pytest.approx(round(0.25 * 5000 / math.sqrt(252) / 0.25) * 0.25)
    assert (rows[7].base, rows[7].vol_1d) == (0.0, None) and rows[6].vol_1d is None


def test_ladders(resolved):
    rows = {(r.pos_no, r.bump): r.value for r in portfolio.ladder(resolved, [0, 10]).collect()}
    assert rows[1, 10.0] == 1100.0 and rows[2, 10.0] == -1000.0 and rows[7, 10.0] == 0.0 and rows[10, 0.0] == 400.0
    assert rows[3, 10.0] == pytest.approx((option(110, 105, 60 / 365, 0.04, 0.4, True, 0.01)[0] - 2) * 300)
    assert rows[4, 0.0] == pytest.approx(option(100, 95, 30 / 365, 0.04, 0.4, False)[0] * 100)
    assert rows[6, 0.0] == pytest.approx(option(100, 100, 30 / 365, 0.04, 0.3, True, forward=True)[0] - 10)


def test_what_must_fail(spark):
    twice = spark.createDataFrame([(dt.date(2024, 1, 2), "A", 1.0), (dt.date(2024, 1, 2), "A", 2.0)], "date date, symbol string, price double")
    with pytest.raises(Exception, match="come twice"):
        panel.pivot(twice, ["A"]).collect()
    sheet = spark.createDataFrame([("s", 0, "2-YEAR FUTURES CONTRACT", None), ("s", 1, None, "x"), ("s", 2, "Tentative 5-YEAR FUTURES CONTRACT", None), ("s", 3, None, "y"), ("s", 4, "10-YEAR FUTURES CONTRACT", None), ("s", 5, None, "z")], "sheet_id string, pos int, c1 string, c2 string")
    assert [r.c2 for r in ingest.contract_block(sheet, "2-YEAR").where("c2 IS NOT NULL").orderBy("pos").collect()] == ["x", "y"]
    with pytest.raises(Exception, match="not found"):
        ingest.contract_block(sheet, "5-YEAR").collect()


def test_more_readers(spark, tmp_path):
    (tmp_path / "f1.csv").write_text("obs_date,px_ident,maturity,price\n2024-01-02,TY,3M,110.5\n")
    (tmp_path / "f2.csv").write_text("obs_date,px_ident,maturity,price\n2024-01-03,FV,,107.25\n")
    got = sorted((r.px_ident, r.maturity, r.price, r.file) for r in ingest.read_futures(spark, str(tmp_path / "f*.csv")).collect())
    assert got == [("FV", None, 107.25, "f2.csv"), ("TY", "3M", 110.5, "f1.csv")]
    (tmp_path / "y1.csv").write_text("date,y5,y30\n2024-01-02,4.0,4.2\n2024-01-02,9.0,9.0\n")
    (tmp_path / "y2.csv").write_text("date,y5,y30\n2024-01-02,8.0,8.0\n2024-01-03,4.1,4.3\n")
    assert sorted((str(r.date), r.y5) for r in ingest.read_yields(spark, str(tmp_path / "y*.csv")).collect()) == [("2024-01-02", 4.0), ("2024-01-03", 4.1)]
    (tmp_path / "p.json").write_text('[{"book_id": "b", "pos_no": 1, "type": "equity", "symbol": "A", "quantity": 2, "open": false}]')
    r = ingest.read_positions(spark, str(tmp_path / "p.json")).first()
    assert (r.symbol, r.quantity, r.open, r.strike) == ("A", 2.0, False, None)
    (tmp_path / "a.csv").write_text('CUSIP,a,b,c,d,e,f,g,h\n 91282CAA1 ,01/25/2024,01/31/2024,01/31/2026,99.875,"$1,234",Semi-Annual,4.250%,"$63,000.50"\n')
    r = ingest.read_auctions(spark, str(tmp_path / "a.csv")).first()
    assert (r.cusip, str(r.maturity_date), r.coupon, float(r.accepted)) == ("91282CAA1", "2026-01-31", 4.25, 63000.5)
    (tmp_path / "i.csv").write_text("curve_id,trade_date,symbol,tenor,type,quote\nc,2026-02-23,ON,1B,Rate,3.6\nc,2026-02-23,junk,1B,,1\n")
    assert [x.symbol for x in ingest.read_instruments(spark, str(tmp_path / "i.csv")).collect()] == ["ON"]
    parts = [spark.createDataFrame(x, "Year int, Month int, Day int") for x in ([(2026, 1, 28), (2026, 3, 18)], [(2026, 3, 18)])]
    assert sorted(map(tuple, ingest.assemble_calendar(*parts).collect())) == [(2026, 1, 28), (2026, 3, 18)]
    assert [str(r[0]) for r in ingest.meeting_calendar(parts[0], "2026-02-01", explicit=["2026-01-01", "2026-06-17"]).collect()] == ["2026-06-17"]


def test_stored_bars_are_one_a_time(spark, tmp_path):
    bars = spark.createDataFrame([("ES", dt.datetime(2024, 1, 2), 2.0), ("ES", dt.datetime(2024, 1, 2), 1.0), ("ES", dt.datetime(2024, 1, 3), 3.0)], "symbol string, dt timestamp, close double")
    ingest.write_bars(bars, str(tmp_path / "b"), [F.desc("close")])
    assert sorted(r.close for r in ingest.read_bars(spark, str(tmp_path / "b")).collect()) == [2.0, 3.0]
