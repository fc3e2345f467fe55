"""Rows of sheets that queries make have a place each, so that results don't hang on the order in which a shuffle brings them."""

import pytest
from pyspark.sql import functions as F

from tidelark.plans import ingest

BRANDS = ("Brand#6", "Brand#7", "Brand#8")
KEYS = {"from zero": range(9), "far": range(9_999_995, 10_000_004), "one": (0,)}


@pytest.mark.parametrize("keys", KEYS.values(), ids=KEYS)
def test_no_place_is_taken_twice(spark, tmp_path, monkeypatch, keys):
    """Sheets' rows come last row first, as a shuffle of several executors may bring them: all are still below their own header."""
    parts = [(k, b, 1 + k % 50) for i, b in enumerate(BRANDS) for k in keys if len(keys) == 1 or k % 3 == i]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    made, real = [], ingest.g.contract_blocks

    def reversed_rows(sheet):
        made.append(sheet)
        return real(sheet.coalesce(1).sortWithinPartitions(F.desc("pos"), F.desc_nulls_last("c2")))

    monkeypatch.setattr(ingest.g, "contract_blocks", reversed_rows)
    got = ingest.blocks(spark, str(tmp_path)).collect()
    assert sorted((r.contract, r.cusip, r.delivery_month) for r in got) == sorted((f"{b.upper()} FUTURES CONTRACT", f"Q{k}", m) for k, b, _ in parts for m in ("Mar-2026", "Jun-2026"))
    assert all(r.cf == (None if r.delivery_month == "Jun-2026" and k % 5 == 0 else pytest.approx((0.85 if r.delivery_month == "Mar-2026" else 0.9) + (1 + k % 50) / 500)) for r in got for k in [int(r.cusip[1:])])
    one = ingest.one_contract(spark, str(tmp_path)).where("cusip IS NOT NULL").collect()
    assert sorted((r.contract, r.cusip) for r in one) == sorted(("BRAND#7 FUTURES CONTRACT", f"Q{k}") for k, b, _ in parts if b == "Brand#7")
    assert len(made) == 2 and not any(s.groupBy("sheet_id", "pos").count().where("count > 1").count() for s in made)
