"""Workbooks (xlsx) read as tables of cells, and the quote and conversion-factor sheets among them."""

from __future__ import annotations

import datetime
import functools
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import mixed_fraction
from .ingest import contract_blocks

#: Rows that are handed on together.
ROWS = 4096
#: Bytes of a sheet up to which its elements are made at once; larger ones are let go of row by row.
SMALL = 1 << 18
#: Numbers of the format's own date formats.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


@functools.lru_cache(1024)
def _parts(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(e: ElementTree.Element) -> str:
    """All text of an element but its phonetic readings."""
    if len(e) == 1 and not len(e[0]) and _parts(e[0].tag) == "t":
        return e[0].text or ""
    return "".join((e2.text or "") for e1 in ([e] if _parts(e.tag) == "t" else [x for x in e if _parts(x.tag) in ("t", "r")]) for e2 in e1.iter() if _parts(e2.tag) == "t")


def _place(reference: str) -> int:
    """B3 -> 1."""
    return _place_of(reference.rstrip("0123456789"))


@functools.lru_cache(1024)
def _place_of(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


@functools.lru_cache(16)
def _date_styles(styles: bytes) -> list[bool]:
    """Of each cell style, whether it shows a date. Workbooks of one writer share their styles, as their list of sheets, which a task therefore reads once."""
    root = ElementTree.fromstring(styles)
    codes = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if _parts(e.tag) == "numFmt"}
    dated = lambda n: bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", codes[n]), re.I)) if n in codes else n in DATE_FORMATS
    return [dated(int(x.get("numFmtId", 0))) for e in root if _parts(e.tag) == "cellXfs" for x in e]


@functools.lru_cache(16)
def _sheets(book: bytes, links: bytes) -> tuple[list[tuple[str, str]], datetime.datetime]:
    """(name, file) of a workbook's sheets, and its day 0."""
    root = ElementTree.fromstring(book)
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(links)}
    since1904 = any(_parts(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root)
    out = []
    for sheet in (e for e in root.iter() if _parts(e.tag) == "sheet"):
        target = targets[next(v for k, v in sheet.attrib.items() if _parts(k) == "id")]
        out.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))))
    return out, datetime.datetime(1904, 1, 1) if since1904 else datetime.datetime(1899, 12, 30)


def _value(c: ElementTree.Element, shared: list[str], dates: list[bool], epoch: datetime.datetime) -> str | None:
    kind, style = c.get("t", "n"), int(c.get("s", 0))
    raw = inline = None
    for e in c:
        part = _parts(e.tag)
        if part == "v" and raw is None:
            raw = e.text
        elif part == "is" and inline is None:
            inline = e
    if kind == "inlineStr":
        return None if inline is None else _text(inline)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind == "n" and style < len(dates) and dates[style]:
        at = epoch + datetime.timedelta(seconds=round(float(raw) * 86400))
        return at.date().isoformat() if at.time() == datetime.time() else at.isoformat(" ")
    return raw


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells) of a workbook's rows that have cells, sheets in the workbook's order. Errors and empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        listed, epoch = _sheets(z.read("xl/workbook.xml"), z.read("xl/_rels/workbook.xml.rels"))
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        dates = _date_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in names else []
        for title, name in listed:
            with z.open(name) as f:
                number = 0
                for e in ElementTree.fromstring(f.read()).iter() if z.getinfo(name).file_size <= SMALL else (e for _, e in ElementTree.iterparse(f)):
                    if _parts(e.tag) != "row":
                        continue
                    number = int(e.get("r", number + 1))
                    cells: list[str | None] = []
                    for c in e:
                        at = _place(c.get("r")) if c.get("r") else len(cells)
                        cells.extend([None] * (at + 1 - len(cells)))
                        cells[at] = _value(c, shared, dates, epoch)
                    e.clear()
                    if any(x is not None for x in cells):
                        yield title, number, cells


def read_sheets(spark: SparkSession, path: str, sheet: str | int | None = None) -> DataFrame:
    """parse_sheets of the workbooks of a path or pattern, on any file system that Spark reads. A task reads whole files: some MB each."""
    return parse_sheets(spark.read.format("binaryFile").load(path).select("path", "content"), sheet)


def parse_sheets(files: DataFrame, sheet: str | int | None = None) -> DataFrame:
    """(file, sheet, pos, cells) of files (path, content): a row for each row with a value, cells as text from column A on.

    Dates are yyyy-MM-dd, with a time behind unless it is midnight; numbers as stored. sheet: one sheet's name, or its place from 0. A
    NULL content has no rows; a file that isn't a workbook fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "sheet", "pos", "cells"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())), strict=True)], names)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, order = [], {}
                for name, pos, cells in workbook_rows(content.as_py()) if content.is_valid else ():
                    order.setdefault(name, len(order))
                    if sheet is None or sheet in (name, order[name]):
                        rows.append((path, name, pos, cells))
                    if len(rows) == ROWS:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    return files.select("path", "content").mapInArrow(run, "file string, sheet string, pos bigint, cells array<string>")


def cell(letters: str) -> Column:
    """The cell of a row in the column of these letters; NULL if the row ends before."""
    return F.get("cells", F.lit(_place(letters)))


def quotes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instruments, params) of quote sheets (file, pos, cells), a curve a file.

    Below the first row, A to D are symbol, tenor, type and quote; rows without a type are left out. F2 is the trade date and P8 the
    volatility in percent, NULL (the default) where there is no number.
    """
    row = F.struct(cell("A").alias("symbol"), F.trim(cell("B")).alias("tenor"), cell("C").alias("type"), cell("D").try_cast("double").alias("quote"))
    one = rows.groupBy(F.col("file").alias("curve_id")).agg(
        F.max(F.when(F.col("pos") == 2, F.try_to_date(F.left(cell("F"), F.lit(10)), "yyyy-MM-dd"))).alias("trade_date"), F.max(F.when(F.col("pos") == 8, cell("P").try_cast("double"))).alias("_sigma"),
        F.collect_list(F.when((F.col("pos") > 1) & cell("C").isNotNull(), row)).alias("_rows"))  # a curve's instruments
    params = one.select("curve_id", "trade_date", F.lit(None).cast("double").alias("hw_a"), (F.col("_sigma") / 100).alias("hw_sigma"))
    return one.where("curve_id IS NOT NULL").select("curve_id", "trade_date", F.inline("_rows")), params


def conversion_factors(rows: DataFrame) -> DataFrame:
    """(contract, coupon, issue_date, maturity, cusip, issuance, delivery_month, cf) of sheets (file, sheet, pos, cells) of contract blocks.

    A block's own line with "Coupon" in C names its months, as dates from column H on; rows below it with a coupon are bonds. cf is NULL for
    ----- and other text. Delivery months are written Mar-2026.
    """
    s = rows.select(F.concat_ws("#", "file", "sheet").alias("sheet_id"), "pos", cell("A").alias("c1"), "cells")
    heads = F.when(F.trim(cell("C")) == "Coupon", F.col("cells"))
    w = Window.partitionBy("sheet_id", "contract").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    d = contract_blocks(s).withColumn("_heads", F.last(heads, ignorenulls=True).over(w)).where(F.col("_heads").isNotNull())
    day = lambda c: F.coalesce(F.try_to_date(F.left(c, F.lit(10)), "yyyy-MM-dd"), F.try_to_date(c, "MM/dd/yyyy"))
    d = d.select("*", (F.coalesce(cell("C").try_cast("double"), mixed_fraction(F.trim(cell("C")))) / 100).alias("coupon")).where("coupon IS NOT NULL")
    d = d.select("contract", "coupon", day(cell("D")).alias("issue_date"), day(cell("E")).alias("maturity"), F.trim(cell("F")).alias("cusip"), F.regexp_replace(cell("G"), "[$,]", "").try_cast("double").alias("issuance"), "cells",
                 F.posexplode(F.slice("_heads", 8, F.greatest(F.size("_heads") - 7, F.lit(0)))).alias("_i", "_month"))
    month = F.date_format(F.try_to_date(F.left("_month", F.lit(10)), "yyyy-MM-dd"), "MMM-yyyy")
    return d.where("_month IS NOT NULL").select("contract", "coupon", "issue_date", "maturity", "cusip", "issuance", month.alias("delivery_month"), F.get("cells", F.col("_i") + 7).try_cast("double").alias("cf"))


def _letters(place: int) -> str:
    out = ""
    while place >= 0:
        place, last = divmod(place, 26)
        out, place = chr(65 + last) + out, place - 1
    return out


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of sheets, each a list of rows of text, numbers, dates and None."""

    def shown(v: object, at: str) -> str:
        if v is None:
            return ""
        if isinstance(v, datetime.date):
            return f'<c r="{at}" s="1"><v>{(v - datetime.date(1899, 12, 30)).days}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml."
    numbers = range(1, len(sheets) + 1)
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}worksheet+xml"/>' for i in numbers) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in zip(numbers, sheets, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r0" Type="{rel}/styles" Target="styles.xml"/>' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>",
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0" xfId="0"/><xf numFmtId="14" xfId="0" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    for i, rows in zip(numbers, sheets.values(), strict=True):
        body = "".join(f'<row r="{k}">' + "".join(shown(v, f"{_letters(j)}{k}") for j, v in enumerate(r)) + "</row>" for k, r in enumerate(rows, 1))
        files[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()
