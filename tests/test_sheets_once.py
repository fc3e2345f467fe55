"""Quote sheets are parsed once, and small and large sheets alike."""

import datetime as dt

from tidelark.plans import rates
from tidelark.sources import sheets

ROWS = [["Symbol", "Tenors", "Type", "Quote"], ["ON", "1B", "Rate", 3.63, None, dt.date(2026, 2, 23)], ["2Y", "2Y", "Swap", 3.5], [None, None, None, "text"], *([] for _ in range(3)), [*[None] * 15, 0.85]]


def test_small_and_large_sheets_alike(monkeypatch):
    book = sheets.workbook({"Q & A": ROWS, "more": [["x", None, 2]]})
    small = list(sheets.workbook_rows(book))
    monkeypatch.setattr(sheets, "SMALL", 0)
    assert list(sheets.workbook_rows(book)) == small and [r[:2] for r in small] == [("Q & A", 1), ("Q & A", 2), ("Q & A", 3), ("Q & A", 4), ("Q & A", 8), ("more", 1)]


def test_sheets_of_a_query_are_parsed_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k,) for k in range(1, 31)], "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    parsed, real = spark.sparkContext.accumulator(0), sheets.parse_sheets

    def counted(files, sheet):
        def run(batches):
            for b in batches:
                parsed.add(b.num_rows)
                yield b

        return real(files.mapInArrow(run, files.schema), sheet)

    monkeypatch.setattr(sheets, "parse_sheets", counted)
    got = rates.quote_sheets(spark, str(tmp_path)).collect()
    assert parsed.value == 30
    monkeypatch.undo()
    key = lambda r: tuple(r.asDict().items())
    assert sorted(map(key, got), key=str) == sorted(map(key, rates.bootstrap(spark, str(tmp_path)).collect()), key=str) and len(got) == 450
