"""Lookups by intervals, paths by rank and the versioned bar store, against plain Python."""

import datetime as dt
import io
import itertools
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelark.operators import intervals, policy
from tidelark.sources import sheets, store


def plain_factor(ts, ls, t):
    if len(ts) == 1:
        return math.exp(ls[0])
    k = min(max(int(np.searchsorted(ts, t)), 1), len(ts) - 1)
    return math.exp(ls[k - 1] + (ls[k] - ls[k - 1]) * (t - ts[k - 1]) / (ts[k] - ts[k - 1]))


def test_discount_factors_in_intervals(spark):
    rng = np.random.default_rng(1)
    curves = {"a": np.r_[0.0, np.sort(rng.uniform(0, 40, 300))], "b": np.array([0.0, 3.0, 90.0, 250.0]), "one": np.array([2.0]), "two": np.array([0.5, 0.75])}
    value = {k: -0.03 * t + rng.normal(0, 0.001, len(t)) for k, t in curves.items()}
    p = spark.createDataFrame([(k, float(t), float(x)) for k in curves for t, x in zip(curves[k], value[k], strict=True)] + [("a", 0.0, float(value["a"][0])), ("b", None, 1.0), ("b", 4.0, None)], "k string, t double, l double")
    at = [("a", float(t)) for t in rng.uniform(-2, 60, 900)] + [("a", 7.25)] * 600 + [("a", float(t)) for t in curves["a"]]
    at += [(k, t) for k in curves for t in (-1.0, 0.0, 0.6, 2.0, 3.0, 63.5, 64.0, 89.0, 100.0, 400.0)] + [("none", 1.0), (None, 1.0), ("a", None), ("b", math.nan)]
    times = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(at)], "i int, k string, t double").repartition(6)
    for options in ({}, {"width": 0.1, "cells": 7, "share": 3}, {"width": 5.0, "cells": 1, "share": 400}):
        out = intervals.discount_factors_at(p, times, ["k"], **options)
        got = {r.i: r.df for r in out.collect()}
        assert len(got) == len(at) == out.count()
        for i, (k, t) in enumerate(at):
            if k not in curves or t is None or math.isnan(t):
                assert got[i] is None or (t is not None and math.isnan(t) and math.isnan(got[i]))
            else:
                assert got[i] == pytest.approx(plain_factor(curves[k], value[k], t), rel=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.discount_factors_at(p, times.where("false"), ["k"]).collect() == []
    assert {r.df for r in intervals.discount_factors_at(p.where("false"), times, ["k"]).collect()} == {None}
    with pytest.raises(ValueError, match="names"):
        intervals.discount_factors_at(p, times.withColumn("low", F.lit(1)), ["k"])


@pytest.mark.parametrize(("moves", "cuts", "hikes", "floor", "cap"), [([-1, 0, 1], 2, 2, None, None), ([0, -2, 1, -1], 3, 1, 0.0301, None), ([1, -1], 4, 3, 0.02, 0.0326), ([0], 0, 0, None, None), ([-3, 2], 2, 1, None, None)])
def test_paths_by_rank(spark, moves, cuts, hikes, floor, cap):
    meetings = [f"2026-0{m}-10" for m in range(1, 7)]
    base = spark.createDataFrame([("x", 0.03), ("y", 0.0325), (None, 0.0351), ("z", None)], "base_id string, initial_rate double")
    want = {}
    for b, r0 in (("x", 0.03), ("y", 0.0325), (None, 0.0351), ("z", None)):
        for raw, path in enumerate(itertools.product(sorted(moves), repeat=6)):
            c, h = sum(-x for x in path if x < 0), sum(x for x in path if x > 0)
            end = None if r0 is None else r0 + (h - c) * 0.0025
            limited = floor is not None or cap is not None
            if c <= cuts and h <= hikes and not (limited and end is None) and (floor is None or end >= floor) and (cap is None or end <= cap):
                days = [", ".join(m for m, x in zip(meetings, path, strict=True) if x * s > 0) or None for s in (-1, 1)]
                want[b, raw] = (c, h, *days, None if end is None else round(end, 6))
    rows = policy.scenarios(base, meetings, moves, max_cuts=cuts, max_hikes=hikes, floor=floor, cap=cap).collect()
    got = {(r.base_id, int(r.scenario_id)): (r.total_cuts, r.total_hikes, r.cut_dates, r.hike_dates, r.terminal_rate) for r in rows}
    assert len(rows) == len(got) and got == want
    ranks = policy.scenarios(base, meetings, moves, max_cuts=cuts, max_hikes=hikes, floor=floor, cap=cap, contiguous=True).collect()
    order = {b: sorted(raw for x, raw in want if x == b) for b in ("x", "y", "z", None)}
    assert {(r.base_id, order[r.base_id][int(r.scenario_id)]): r.cut_dates for r in ranks} == {k: v[2] for k, v in want.items()}


def test_many_meetings(spark):
    base = spark.createDataFrame([(1, 0.03), (2, 0.05)], "base_id int, initial_rate double")
    count = lambda n, c, h: sum(math.comb(n, i) * math.comb(n - i, j) for i in range(c + 1) for j in range(h + 1))
    days = [f"{2026 + i // 12}-{i % 12 + 1:02d}-15" for i in range(40)]
    size = {}
    for n in (16, 40):
        s = policy.scenarios(base, days[:n], [-1, 0, 1])
        r = s.groupBy("base_id").agg(F.count("*").alias("n"), F.countDistinct("scenario_id").alias("d"), F.max("scenario_id").alias("last"), F.max("total_cuts").alias("c")).collect()
        assert len(r) == 2 and all(x.n == x.d == count(n, 2, 2) and x.c == 2 for x in r)
        assert {int(x["last"]) for x in r} == {int("22" + "1" * (n - 2), 3)}
        size[n] = s._jdf.queryExecution().optimizedPlan().numberedTreeString().count("\n")
    assert size[16] == size[40]
    with pytest.raises(Exception, match="more paths"):
        policy.scenarios(base, days * 3, [-1, 0, 1], max_cuts=60, max_hikes=60).count()
    assert policy.scenarios(base, [], [-1, 0, 1]).count() == 2 and policy.scenarios(base.where("false"), days, [-1, 0, 1]).count() == 0


def bars_of(spark, rows, columns="symbol string, dt timestamp, close double"):
    return spark.createDataFrame([(s, dt.datetime(2024 if k < 9 else 2025, 1, k % 9 + 1), *x) for s, k, *x in rows], columns)


def closes(df):
    rows = df.collect()
    assert len({(r.symbol, r.dt) for r in rows}) == len(rows)
    return {(r.symbol, str(r.dt)[:10]): r.close for r in rows}


def test_commits_of_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.commits(spark, path) == []
    with pytest.raises(ValueError, match="no commit"):
        store.snapshot(spark, path)
    assert store.add_bars(bars_of(spark, [("A", 1, 1.0), ("2024", 2, 2.0)]), path, "one") == 1
    before = store.snapshot(spark, path)
    assert store.add_bars(bars_of(spark, [("A", 1, 9.0), ("A", 3, 3.0), ("A", 3, 3.5), ("A", 10, 4.0)]), path, "two", [F.desc("close")]) == 2
    assert store.add_bars(bars_of(spark, [("B", 1, 7.0)]), path, "one") == 1  # run again: nothing changes
    first, second = {("A", "2024-01-02"): 1.0, ("2024", "2024-01-03"): 2.0}, {("A", "2024-01-04"): 3.5, ("A", "2025-01-02"): 4.0}
    assert closes(before) == first == closes(store.snapshot(spark, path, 1))
    assert closes(store.snapshot(spark, path)) == first | second
    assert closes(store.snapshot(spark, path, symbol="2024")) == {("2024", "2024-01-03"): 2.0}
    assert "symbol" in (store.snapshot(spark, path, symbol="2024")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0])
    assert store.compact(spark, path) == 3 and closes(store.snapshot(spark, path)) == first | second
    wider = bars_of(spark, [("A", 1, 8.0, 5), ("C", 1, 6.0, 5)], "symbol string, dt timestamp, close double, volume bigint")
    assert store.add_bars(wider, path) == 4
    got = {(r.symbol, r.close, r.volume) for r in store.snapshot(spark, path).collect()}
    assert ("C", 6.0, 5) in got and ("A", 1.0, None) in got and len(got) == 5
    assert store.add_bars(wider.where("false"), path, "none") == 5 and store.snapshot(spark, path).count() == 5
    assert store.vacuum(spark, path) == [] and len(store.vacuum(spark, path, 0.0)) == 2
    assert store.snapshot(spark, path).count() == 5 and closes(store.snapshot(spark, path, 3)) == first | second
    with pytest.raises(ValueError, match="no commit"):
        store.snapshot(spark, path, 77)


def test_a_write_that_fails_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "store")
    store.add_bars(bars_of(spark, [("A", 1, 1.0)]), path, "one")
    broken = bars_of(spark, [("A", k, float(k)) for k in range(2, 8)]).withColumn("close", F.when(F.col("close") < 7, F.col("close")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        store.add_bars(broken, path, "two")
    assert closes(store.snapshot(spark, path)) == {("A", "2024-01-02"): 1.0}
    store._write(bars_of(spark, [("A", 5, 5.0)]), path)  # a job that died between its files and its commit
    (tmp_path / "store" / "commits" / ".half.tmp").write_text("{")
    assert closes(store.snapshot(spark, path)) == {("A", "2024-01-02"): 1.0}
    assert store.add_bars(bars_of(spark, [("A", 2, 2.0)]), path, "two") == 2 and len(store.snapshot(spark, path).collect()) == 2


def test_two_writers_get_two_numbers(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "store"), store.commits
    store.add_bars(bars_of(spark, [("A", 1, 1.0)]), path, "one")
    looks = []

    def late(*args):  # the first two looks of this writer are before the other's commit
        looks.append(1)
        return real(*args) if len(looks) > 2 else []

    monkeypatch.setattr(store, "commits", late)
    assert store.add_bars(bars_of(spark, [("A", 2, 2.0)]), path, "two") == 2
    monkeypatch.undo()
    assert [c["batch"] for c in store.commits(spark, path)] == ["one", "two"] and store.snapshot(spark, path).count() == 2


def test_workbooks(spark, tmp_path):
    rows = [["Symbol", "Tenors", "Type", "Quote"], ["ON", "1B", "Rate", 3.63, None, dt.date(2026, 2, 23)], ["2Y", " 2Y ", "Swap", 3.5], [], ["note <&> only"], ["SOFR3M6", "3M", "Future", "96.5"], [], [*[None] * 15, 0.85]]
    (tmp_path / "curve a.xlsx").write_bytes(sheets.workbook({"Q & A": rows, "other": [["x"] * 30]}))
    (tmp_path / "empty.xlsx").write_bytes(sheets.workbook({"Q": []}))
    got = {r.pos: r.cells for r in sheets.read_sheets(spark, str(tmp_path / "*.xlsx"), "Q & A").collect()}
    assert got == {1: ["Symbol", "Tenors", "Type", "Quote"], 2: ["ON", "1B", "Rate", "3.63", None, "2026-02-23"], 3: ["2Y", " 2Y ", "Swap", "3.5"], 5: ["note <&> only"], 6: ["SOFR3M6", "3M", "Future", "96.5"], 8: [*[None] * 15, "0.85"]}
    assert sheets.read_sheets(spark, str(tmp_path), 1).first().cells == ["x"] * 30 and sheets.read_sheets(spark, str(tmp_path)).count() == 7
    i, p = sheets.quotes(sheets.read_sheets(spark, str(tmp_path), 0))
    assert sorted((r.symbol, r.tenor, r.quote, str(r.trade_date)) for r in i.collect()) == [("2Y", "2Y", 3.5, "2026-02-23"), ("ON", "1B", 3.63, "2026-02-23"), ("SOFR3M6", "3M", 96.5, "2026-02-23")]
    assert [(r.hw_a, round(r.hw_sigma, 9)) for r in p.collect()] == [(None, 0.0085)]


def test_workbooks_of_other_writers(spark):
    """Shared and rich strings, formulas, booleans, errors, own date formats, the later epoch, rows and cells without places."""
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><workbookPr date1904="1"/><sheets><sheet name="S" sheetId="9" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="/xl/worksheets/a.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="[Red]mmm-yy"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        "xl/worksheets/a.xml": f'<worksheet {main}><sheetData><row><c t="s"><v>1</v></c><c t="s"><v>0</v></c><c t="str"><f>A1</f><v>two</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c></row><row r="7"><c r="AB7" s="1"><v>1.5</v></c><c s="2"><v>2.5</v></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    d = spark.createDataFrame([("f", bytearray(out.getvalue())), ("none", None)], "path string, content binary")
    assert {r.pos: r.cells for r in sheets.parse_sheets(d).collect()} == {1: ["two", "one", "two", "true", None], 7: [*[None] * 27, "1904-01-02 12:00:00", "2.5"]}
    with pytest.raises(Exception, match="zip"):
        sheets.parse_sheets(d.withColumn("content", F.encode(F.lit("text"), "UTF-8"))).count()


def test_factor_sheets_have_their_own_months(spark):
    block = lambda name, months, *bonds: [[f"{name} FUTURES CONTRACT"], [None, None, "Coupon", *[None] * 4, *months], *([None, 1, *b] for b in bonds)]
    issue = dt.date(2025, 1, 31)
    rows = block("2-YEAR", [dt.date(2026, 3, 1), dt.date(2026, 6, 1)], ["3 7/8", issue, "01/31/2027", "C1", "$42", 0.97, "-----"], [4.125, issue, issue, " C2 ", 7, 0.98, 0.99])
    rows += block("Tentative 9-YEAR", [dt.date(2030, 1, 1)]) + block("5-YEAR", [dt.date(2026, 9, 1)], ["1/2", issue, issue, "C3", None, "0.9"], [None, issue])
    d = spark.createDataFrame([("f", bytearray(sheets.workbook({"CF": rows})))], "path string, content binary")
    got = sorted((r.contract[:6], r.cusip, round(r.coupon, 9), str(r.maturity), r.issuance, r.delivery_month, r.cf) for r in sheets.conversion_factors(sheets.parse_sheets(d)).collect())
    assert got == [("2-YEAR", "C1", 0.03875, "2027-01-31", 42.0, "Jun-2026", None), ("2-YEAR", "C1", 0.03875, "2027-01-31", 42.0, "Mar-2026", 0.97), ("2-YEAR", "C2", 0.04125, "2025-01-31", 7.0, "Jun-2026", 0.99), ("2-YEAR", "C2", 0.04125, "2025-01-31", 7.0, "Mar-2026", 0.98), ("5-YEAR", "C3", 0.005, "2025-01-31", None, "Sep-2026", 0.9)]
