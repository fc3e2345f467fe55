"""Bonds alike are priced once, and yields are found a batch at a time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelark.operators import policy


def test_yields_of_a_column(spark):
    price = lambda y, c, n: sum(c / 2 * 100 / (1 + y / 2) ** k for k in range(1, n + 1)) + 100 / (1 + y / 2) ** n
    rows = [(price(y, c, n), c, n, y) for y in (-0.2, -0.01, 0.0, 0.035, 0.4) for c in (0.0, 0.05) for n in (1, 7, 40)]
    rows += [(None, 0.05, 3, None), (float("nan"), 0.05, 3, None), (95.0, None, 3, None), (1e9, 0.05, 3, None), (0.01, 0.05, 3, None), (95.0, 0.05, None, None)]
    d = spark.createDataFrame(rows, "p double, c double, n int, y double")
    for r in d.select("y", policy.yield_of(F.col("p"), F.col("c"), F.col("n")).alias("got")).collect():
        assert r.got == (None if r.y is None else pytest.approx(r.y, abs=1e-9))


def test_bonds_alike_are_priced_once(spark, monkeypatch):
    day, solved = dt.date(2026, 2, 23), spark.sparkContext.accumulator(0)
    paths = spark.createDataFrame([(b, s, k / 364, 1 - (b + s) * k / 1e5) for b in (1, 2) for s in (0, 1, 2) for k in range(1, 729)], "base_id int, scenario_id int, t double, df double")
    rows = [(k, (None, 0.03, 0.04)[k % 3], (dt.date(2026, 8, 31), dt.date(2027, 11, 15))[k % 2]) for k in range(60)] + [(100, 0.03, day), (101, 0.03, None), (None, 0.03, dt.date(2026, 8, 31))]
    bonds = spark.createDataFrame(rows, "bond_id int, coupon double, maturity date")
    real = policy.yields

    def counted(d, *rest):
        solved.add(len(d))
        return real(d, *rest)

    monkeypatch.setattr(policy, "yield_of", lambda d, c, n, face, freq: F.arrow_udf(_batch(counted, face, freq), "double")(d, c, n))
    got = policy.price_bonds(paths, bonds, str(day), 364.0).collect()
    assert len(got) == 6 * 61 and len({(r.base_id, r.scenario_id, r.bond_id) for r in got}) == len(got)
    assert solved.value == 6 * 6
    by = {r[0]: r[1:] for r in rows}
    same = {}
    for r in got:
        x = (r.dirty, r.clean, r.accrued, r.ytm)
        assert same.setdefault((r.base_id, r.scenario_id, by[r.bond_id]), x) == x and (x[3] is None) == (by[r.bond_id][0] is None)


def _batch(f, face, freq):
    import numpy as np
    import pyarrow as pa

    def run(d: pa.Array, c: pa.Array, n: pa.Array) -> pa.Array:
        y = f(*(x.to_numpy(zero_copy_only=False).astype(float) for x in (d, c, n)), face, freq, -0.5, 1.0, 60)
        return pa.array(y, mask=np.isnan(y))

    return run
