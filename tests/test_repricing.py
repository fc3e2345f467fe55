"""Curves on the tenor grid: dates and rates against columns and plain Python, and how often curves are solved."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelark.functions import dates
from tidelark.operators import curves


def plain_factor(ts, ls, t):
    k = max(1, min(len(ts) - 1, sum(x < t for x in ts)))
    return 2.718281828459045 ** (ls[k - 1] + (ls[k] - ls[k - 1]) * (t - ts[k - 1]) / (ts[k] - ts[k - 1]))


def some_curves(spark, days):
    """Solved curves (curve_id, trade_date, ts, ls, status), one a day."""
    rows = [(i, day, [0.0, 0.01, 0.5 + i / 100, 2.0, 10.0, 30.5], [0.0, -0.0003, -0.02, -0.07 - i / 1000, -0.4, -1.3], None) for i, day in enumerate(days)]
    rows += [(-1, days[0], [0.0], [0.0], "stopped"), (-2, None, [0.0, 1.0], [0.0, -0.1], None), (-3, days[0], [0.0], [0.0], None)]
    return spark.createDataFrame(rows, "curve_id int, trade_date date, ts array<double>, ls array<double>, status string")


def test_grid_against_columns(spark):
    days = [dt.date(2024, 2, 27) + dt.timedelta(k) for k in (*range(12), 365, 700, 2140)]
    got = {(r.curve_id, r.tenor): r for r in curves.reprice_grid(some_curves(spark, days)).collect()}
    assert len(got) == (len(days) + 1) * len(curves.GRID) and {k for k, _ in got} == {*range(len(days)), -3}
    t = curves.trade_days(some_curves(spark, days).where("curve_id >= 0")).withColumn("tenor", F.explode(F.array(*map(F.lit, curves.GRID))))
    t = t.withColumn("base", F.when(F.right("tenor", F.lit(1)).isin("D", "W"), F.col("trade_date")).otherwise(F.col("effective")))
    t = t.withColumn("mat", dates.add_tenor(F.col("base"), F.col("tenor"))).withColumn("prev_bd", dates.previous_business_day(F.col("mat")))
    paid = {}
    for r in dates.annual_schedule(t.where("mat > one_year").select("curve_id", "trade_date", "tenor", "effective", "mat"), "effective", "mat").collect():
        paid.setdefault((r.curve_id, r.tenor), []).append(r.coupon_date)
    for r in t.collect():
        x = got[r.curve_id, r.tenor]
        years = lambda a, b: (b - a).days / 360
        at = lambda d, r=r: plain_factor(r.ts, r.ls, (d - r.trade_date).days / 360)
        coupons = sorted(paid.get((r.curve_id, r.tenor), []))
        if coupons:
            par = (at(r.effective) - at(r.mat)) / sum(years(a, b) * at(b) for a, b in zip([r.effective, *coupons], coupons, strict=False))
        else:
            par = (at(r.effective) / at(r.mat) - 1) / years(r.effective, r.mat) if r.mat != r.effective else None
        assert x.mat == r.mat and x.df == pytest.approx(at(r.mat), rel=1e-13) and x.par == (None if par is None else pytest.approx(100 * par, rel=1e-11))
        assert x.forward_1d == pytest.approx(100 * (at(r.prev_bd) / at(r.mat) - 1) / years(r.prev_bd, r.mat), rel=1e-9)
        assert x.flat == pytest.approx(36000 * (at(r.mat) ** (-1 / (r.mat - r.trade_date).days) - 1), rel=1e-9)


def test_curves_are_solved_once_for_their_grid(spark):
    solved = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            solved.add(b.num_rows)
            yield b

    c = some_curves(spark, [dt.date(2026, 2, 23)] * 50)
    c = c.mapInArrow(counted, c.schema)
    assert curves.reprice_grid(c).count() == 51 * len(curves.GRID) and solved.value == 53


def test_grids_are_compared_by_curve(spark):
    a = some_curves(spark, [dt.date(2026, 2, 23), dt.date(2026, 2, 24)])
    b = a.where("curve_id <> 1").withColumn("ls", F.transform("ls", lambda x: x * 1.01))
    got = {(r.curve_id, r.tenor): (r.rate_a, r.rate_b, r.diff_bp) for r in curves.compare_grids(curves.grids(a), curves.grids(b), "par").collect()}
    rows = lambda d: curves.reprice_grid(d).select("curve_id", "trade_date", "tenor", "par")
    want = {(r.curve_id, r.tenor): (r.rate_a, r.rate_b, r.diff_bp) for r in curves.compare_rates(rows(a), rows(b), "par", ["curve_id", "trade_date", "tenor"]).collect()}
    assert got == want and {k for k, _ in got} == {0, -3}
