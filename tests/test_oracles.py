"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

from tidelark.plans import dates, ingest, panel, portfolio, rates

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
CASES = [(plan, name) for plan in (panel, dates, portfolio, rates, ingest) for name in plan.S]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return str(v)[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize(("plan", "name"), CASES, ids=[n for _, n in CASES])
def test_same_as_sql(spark, duck, plan, name):
    ours = plan.Q[name](spark, SF)
    theirs = duck.sql(plan.S[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(r[c]) for c in names) for r in ours.collect()), key=key)
    at = [theirs.columns.index(c) for c in names]
    b = sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=key)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if any(u != v and not (isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) <= 2e-5 * max(1, abs(u))) for u, v in zip(x, y, strict=True))]
    assert not wrong, wrong[:3]
