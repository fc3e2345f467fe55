"""Queries on ingestion, over text and payloads that Spark makes of the warehouse tables."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..sources import ingest as g
from ..sources import sheets, store
from .tables import BARS_SQL, bars, read

Q, S = {}, {}


def query(name: str, sql: str):
    def add(f):
        Q[name] = f
        S[name] = sql
        return f

    return add


def landed(df, kind: str) -> str:
    """Writes df as files of a kind to a folder that driver and executors share, and returns it."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{shared or tempfile.mkdtemp(prefix='spark-landed-')}/landed-{uuid.uuid4().hex}"
    (df.write.option("header", True) if kind == "csv" else df.write).format(kind).save(path)
    return path


@query("s1_equities", "SELECT CAST(l_shipdate AS DATE) AS trading_date, 'P' || l_partkey AS ric, l_extendedprice AS last, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS volume FROM lineitem")
def equities(spark, d):
    li = read(spark, d, "lineitem")
    raw = li.select(F.col("l_shipdate").cast("date").alias("trading_date"), F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit(".N")).alias("ric"), F.col("l_extendedprice").alias("last"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("volume"))
    return g.read_equities(spark, landed(raw, "csv"))


@query("s2_futures", "SELECT CAST(o_orderdate AS DATE) AS obs_date, o_orderpriority AS px_ident, CASE WHEN o_orderkey % 3 <> 0 THEN '3M' END AS maturity, o_totalprice AS price FROM orders")
def futures(spark, d):
    raw = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("obs_date"), F.col("o_orderpriority").alias("px_ident"), F.when(F.col("o_orderkey") % 3 != 0, "3M").alias("maturity"), F.col("o_totalprice").alias("price"))
    return g.read_futures(spark, landed(raw, "csv")).drop("file")


@query("s9_instruments", "SELECT 'c' || c_custkey AS curve_id, DATE '2026-02-23' AS trade_date, c_mktsegment AS symbol, '2Y' AS tenor, 'Swap' AS type, c_acctbal AS quote FROM customer WHERE c_custkey % 4 <> 0")
def quotes(spark, d):
    c = F.col("c_custkey")
    raw = read(spark, d, "customer").select(F.concat(F.lit("c"), c.cast("string")).alias("curve_id"), F.lit("2026-02-23").alias("trade_date"), F.col("c_mktsegment").alias("symbol"), F.lit("2Y").alias("tenor"), F.when(c % 4 != 0, "Swap").alias("type"), F.col("c_acctbal").alias("quote"))
    return g.read_instruments(spark, landed(raw, "csv"))


@query("s16_bar_store", "WITH " + BARS_SQL.format(unit="day") + " SELECT symbol, dt, close, volume FROM bars")
def bar_store(spark, d):
    """Bars written to the store, each twice, and read back: one a symbol and time is kept, that of the greater close."""
    b = bars(spark, d).withColumn("dt", F.col("dt").cast("timestamp"))
    path = landed(b.limit(0).select("symbol"), "parquet") + "-bars"
    g.write_bars(b.unionByName(b.withColumn("close", F.col("close") - 1)), path, [F.desc("close")])
    return g.read_bars(spark, path).select("symbol", F.col("dt").cast("timestamp_ntz").alias("dt"), "close", "volume")


@query("s19_store_commits", "WITH " + BARS_SQL.format(unit="day") + " SELECT symbol, dt, CASE WHEN day(dt) % 3 = 0 THEN -close ELSE close END AS close, CASE WHEN day(dt) % 3 = 0 THEN volume END AS volume FROM bars")
def store_commits(spark, d):
    """Two thirds of the bars without volumes, then all with negated closes, one batch twice, a compaction between and a batch after it: what was stored first is read."""
    b = bars(spark, d).withColumn("dt", F.col("dt").cast("timestamp")).select("symbol", "dt", "close", "volume")
    later = b.withColumn("close", -F.col("close"))
    path = landed(b.limit(0).select("symbol"), "parquet") + "-commits"
    for day in (1, 2):
        store.add_bars(b.where(f"day(dt) % 3 = {day}").drop("volume"), path, f"day {day}")
        store.add_bars(later, path, "day 1")
    store.compact(spark, path)
    store.add_bars(later, path, "all")
    return store.snapshot(spark, path).withColumn("dt", F.col("dt").cast("timestamp_ntz"))


@query("s4_specs_with_defaults", "SELECT p_partkey, p_brand AS symbol, CASE WHEN p_brand < 'Brand#3' THEN 50.0 ELSE 1.0 END::DOUBLE AS multiplier, CASE WHEN p_brand < 'Brand#3' THEN 0.25 ELSE 1.0 END::DOUBLE AS tick_size, CASE WHEN p_brand < 'Brand#3' THEN 12.5 ELSE 1.0 END::DOUBLE AS tick_value, CASE WHEN p_brand < 'Brand#3' THEN 'Rates' ELSE 'Unknown' END AS asset_class FROM part")
def specs(spark, d):
    part = read(spark, d, "part")
    s = part.where("p_brand < 'Brand#3'").select(F.col("p_brand").alias("symbol")).distinct().selectExpr("symbol", "50D AS multiplier", "0.25D AS tick_size", "12.5D AS tick_value", "'Rates' AS asset_class")
    return g.specs_with_defaults(part.select("p_partkey", F.col("p_brand").alias("symbol")), s)


@query("s6_keep_first", "SELECT CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, (o_orderpriority, o_orderkey)) AS y5 FROM orders GROUP BY 1")
def first_rows(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("y5"), "o_orderpriority", "o_orderkey")
    return g.keep_first(o, ["date"], [F.col("o_orderpriority"), F.col("o_orderkey")]).select("date", "y5")


@query("s7_etf_times", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 16 HOUR AS trading_date, o_orderpriority AS ric FROM orders")
def etf(spark, d):
    raw = read(spark, d, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" 04:00:00 PM")).alias("trading_date"), F.col("o_orderpriority").alias("ric"))
    return g.parse_etf(raw).withColumn("trading_date", F.col("trading_date").cast("timestamp_ntz"))


@query("s8_meeting_calendar", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS meeting_date FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-06-01'")
def meetings(spark, d):
    raw = read(spark, d, "orders").select(F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("Month"), F.dayofmonth("o_orderdate").alias("Day"))
    return g.meeting_calendar(raw, "1995-06-01")


@query("s11_auctions", "SELECT 'C' || l_orderkey || '-' || l_linenumber AS cusip, CAST(l_shipdate AS DATE) AS issue_date, round(l_discount * 100, 3) AS coupon, round(floor(l_extendedprice), 2) AS accepted FROM lineitem")
def auctions(spark, d):
    li = read(spark, d, "lineitem")
    day = F.date_format("l_shipdate", "MM/dd/yyyy")
    raw = li.select(F.concat(F.lit(" C"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(" ")).alias("a"), day.alias("b"), day.alias("c"), F.lit(None).cast("string").alias("d"), F.lit("99.875").alias("e"), F.lit("").alias("f"), F.lit("Semi").alias("g"), F.concat(F.format_string("%.3f", F.col("l_discount") * 100), F.lit("%")).alias("h"), F.concat(F.lit("$"), F.format_number(F.floor("l_extendedprice"), 0)).alias("i"))
    return g.parse_auctions(raw).select("cusip", "issue_date", "coupon", F.col("accepted").cast("double").alias("accepted"))


CF = """bk AS (SELECT p_partkey, p_brand, p_size, p_retailprice, p_partkey % 8 AS e FROM part)"""


@query("s12_s13_contract_blocks", f"""WITH {CF}, r AS (SELECT upper(p_brand) || ' FUTURES CONTRACT' AS contract, (p_size + e / 8.0::DOUBLE) / 100 AS coupon, 'Q' || p_partkey AS cusip, 0.85::DOUBLE + p_size / 500.0::DOUBLE AS m1, CASE WHEN p_partkey % 5 <> 0 THEN 0.9::DOUBLE + p_size / 500.0::DOUBLE END AS m2 FROM bk)
SELECT contract, round(coupon, 8) AS coupon, cusip, 'Mar-2026' AS delivery_month, round(m1, 6) AS cf FROM r UNION ALL SELECT contract, round(coupon, 8), cusip, 'Jun-2026', round(m2, 6) FROM r""")
def blocks(spark, d):
    """A sheet a brand: rows stand at their part key, the contract's header and the line of names at the two places before the first, so that no place is taken twice."""
    part = read(spark, d, "part")
    cols = ["c1", "c2", "c3", "c4", "c5", "c6", "c7", "Mar-2026", "Jun-2026"]
    none = lambda n: [F.lit(None).cast("string").alias(c) for c in n]
    heads = part.groupBy(F.col("p_brand").alias("b")).agg((F.min("p_partkey") - 2).alias("pos")).select(F.col("b").alias("sheet_id"), "pos", F.concat(F.upper("b"), F.lit(" FUTURES CONTRACT")).alias("c1"), *none(cols[1:]))
    names = heads.select("sheet_id", (F.col("pos") + 1).alias("pos"), *none(cols[:2]), F.lit("Coupon").alias("c3"), *none(cols[3:]))
    eighth = F.col("p_partkey") % 8
    rows = part.select(F.col("p_brand").alias("sheet_id"), F.col("p_partkey").alias("pos"), F.lit(None).cast("string").alias("c1"), F.col("p_partkey").cast("string").alias("c2"), F.when(eighth == 0, F.col("p_size").cast("string")).otherwise(F.concat_ws(" ", F.col("p_size").cast("string"), F.concat(eighth.cast("string"), F.lit("/8")))).alias("c3"), F.lit("01/15/2024").alias("c4"), F.lit("01/15/2034").alias("c5"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("c6"), F.lit("$42").alias("c7"),
                       (F.lit(0.85) + F.col("p_size") / 500.0).cast("string").alias("Mar-2026"), F.when(F.col("p_partkey") % 5 != 0, (F.lit(0.9) + F.col("p_size") / 500.0).cast("string")).otherwise("-----").alias("Jun-2026"))
    sheet = heads.unionByName(names).unionByName(rows)
    out = g.clean_blocks(g.contract_blocks(sheet), ["Mar-2026", "Jun-2026"])
    return out.select("contract", F.round("coupon", 8).alias("coupon"), "cusip", "delivery_month", F.round("cf", 6).alias("cf"))


@query("s12_factor_sheets", S["s12_s13_contract_blocks"])
def factor_sheets(spark, d):
    """Workbooks of a brand's contract each, 2,000 part keys to a book, read back: months are the dates of each sheet's own header."""
    part = read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.floor(F.col("p_partkey") / 2000).alias("book"), F.struct("p_partkey", "p_size").alias("row"))
    books = part.groupBy("brand", "book").agg(F.collect_list("row").alias("rows"))

    def pages(batches):
        for b in batches:
            out = []
            for brand, rows in zip(b.column("brand").to_pylist(), b.column("rows").to_pylist(), strict=True):
                none = [None] * 4
                body = [[f"{brand.upper()} FUTURES CONTRACT"], [None, None, "Coupon", *none, dt.date(2026, 3, 1), dt.date(2026, 6, 1)]]
                for i, r in enumerate(rows):
                    key, size = r["p_partkey"], r["p_size"]
                    coupon = f"{size} {key % 8}/8" if key % 8 else size
                    body.append([None, i + 1, coupon, dt.date(2024, 1, 15), "01/15/2034", f"Q{key}", "$42", 0.85 + size / 500, 0.9 + size / 500 if key % 5 else "-----"])
                out.append((f"{brand}-{rows[0]['p_partkey']}", sheets.workbook({"Notes": [["none"]], "Conversion Factors": body})))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.binary()), strict=True)], ["path", "content"]) if out else pa.RecordBatch.from_pylist([], pa.schema({"path": pa.string(), "content": pa.binary()}))

    files = books.mapInArrow(pages, "path string, content binary")
    out = sheets.conversion_factors(sheets.parse_sheets(files, "Conversion Factors"))
    return out.select("contract", F.round("coupon", 8).alias("coupon"), "cusip", "delivery_month", F.round("cf", 6).alias("cf"))


@query("s12_one_contract", f"""WITH {CF} SELECT 'BRAND#7 FUTURES CONTRACT' AS contract, 'Q' || p_partkey AS cusip, p_partkey::VARCHAR AS row_no FROM bk WHERE p_brand = 'Brand#7'""")
def one_contract(spark, d):
    """One sheet of all brands, 10^12 places each: rows stand at their part key, a header at the place before a brand's first row."""
    part = read(spark, d, "part").select(F.col("p_brand").alias("b"), "p_partkey")
    n = F.substring("b", 7, 3).cast("long") * 10**12
    text = lambda c: F.lit(None).cast("string").alias(c)
    heads = part.groupBy("b").agg(F.min("p_partkey").alias("p")).select(F.lit("s").alias("sheet_id"), (n + F.col("p") - 1).alias("pos"), F.concat(F.upper("b"), F.lit(" FUTURES CONTRACT")).alias("c1"), text("c2"), text("c6"))
    rows = part.select(F.lit("s").alias("sheet_id"), (n + F.col("p_partkey")).alias("pos"), text("c1"), F.col("p_partkey").cast("string").alias("c2"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("c6"))
    return g.contract_block(heads.unionByName(rows), "BRAND#7 ").select("contract", F.col("c6").alias("cusip"), F.col("c2").alias("row_no"))


@query("s14_symbols", "SELECT p_brand AS ticker, '/' || arg_max(p_type, p_partkey) AS symbol, arg_max(p_name, p_partkey) AS description FROM part WHERE p_partkey % 10 <> 0 GROUP BY p_brand")
def symbols(spark, d):
    line = F.when(F.col("p_partkey") % 20 == 0, "# note, text").when(F.col("p_partkey") % 10 == 0, "  ").otherwise(F.concat(F.col("p_brand"), F.lit(",/"), F.col("p_type"), F.lit(", "), F.col("p_name")))
    return g.parse_symbols(read(spark, d, "part").select(line.alias("value"), F.col("p_partkey").alias("pos")))


@query("s17_candles", "WITH " + BARS_SQL.format(unit="hour") + " SELECT symbol, dt, open, close, volume FROM bars")
def candles(spark, d):
    b = bars(spark, d, "hour").withColumn("dt", F.col("dt").cast("timestamp"))
    pay = b.groupBy("symbol", F.to_date("dt").alias("day")).agg(F.collect_list(F.struct(F.unix_millis("dt").alias("datetime"), "open", "high", "low", "close", "volume")).alias("candles"))  # 24 a day
    return g.decode_candles(pay).select("symbol", F.col("dt").cast("timestamp_ntz").alias("dt"), "open", "close", "volume")


@query("s18_coverage_gaps", """WITH b AS (SELECT o_custkey AS symbol, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY 1), s AS (SELECT c_custkey AS symbol, lo, hi FROM customer LEFT JOIN b ON symbol = c_custkey)
SELECT symbol, DATE '1994-01-01' AS begin, DATE '2000-06-30' AS finish FROM s WHERE lo IS NULL UNION ALL SELECT symbol, DATE '1994-01-01', lo - 1 FROM s WHERE DATE '1994-01-01' < lo - 1 UNION ALL SELECT symbol, hi + 1, DATE '2000-06-30' FROM s WHERE DATE '2000-06-30' > hi + 1""")
def gaps(spark, d):
    b = read(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("dt"))
    return g.coverage_gaps(read(spark, d, "customer").select(F.col("c_custkey").alias("symbol")), b, "1994-01-01", "2000-06-30")


@query("s19_upsert", "WITH " + BARS_SQL.format(unit="day") + """, n AS (SELECT symbol, dt + to_days((volume % 3)::INT) AS dt, min(close) AS close FROM bars GROUP BY 1, 2), u AS (SELECT symbol, dt, close FROM bars WHERE day(dt) % 3 <> 0 UNION ALL SELECT symbol, dt, -close FROM n WHERE (symbol, dt) NOT IN (SELECT (symbol, dt) FROM bars WHERE day(dt) % 3 <> 0))
SELECT symbol, dt, close FROM u WHERE dt BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'""")
def upsert(spark, d):
    b = bars(spark, d).withColumn("dt", F.col("dt").cast("timestamp"))
    new = b.select("symbol", F.col("dt") + F.make_dt_interval((F.col("volume") % 3).cast("int")), "close").toDF("symbol", "dt", "close").groupBy("symbol", "dt").agg((-F.min("close")).alias("close"))
    out = g.in_range(g.upsert_bars(b.where("day(dt) % 3 <> 0").select("symbol", "dt", "close"), new), "2024-01-03", "2024-01-25")
    return out.withColumn("dt", F.col("dt").cast("timestamp_ntz"))


@query("s20_historical_meetings", """SELECT year(o_orderdate)::INT AS Year, CASE WHEN o_orderkey % 3 = 2 THEN month(o_orderdate) % 12 + 1 ELSE month(o_orderdate) END::INT AS Month, CASE o_orderkey % 3 WHEN 0 THEN day(o_orderdate) WHEN 1 THEN least(day(o_orderdate) + 1, 31) ELSE 2 END::INT AS Day, count(*) AS n FROM orders GROUP BY 1, 2, 3""")
def historical(spark, d):
    names = F.array(*(F.lit(m) for m in g.MONTHS))
    o = read(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"), (F.col("o_orderkey") % 3).alias("k"))
    name = F.get(names, F.col("m") - 1)
    text = F.when(F.col("k") == 0, F.concat_ws(" ", name, "d")).when(F.col("k") == 1, F.concat(name, F.lit(" "), F.col("d").cast("string"), F.lit("-"), F.least(F.col("d") + 1, F.lit(31)).cast("string"))).otherwise(F.concat(name, F.lit(" "), F.col("d").cast("string"), F.lit("-"), F.get(names, F.col("m") % 12), F.lit(" 2")))
    pages = o.select("year", F.concat(F.lit("<h5>"), text, F.lit(" Meeting - "), F.col("year").cast("string"), F.lit("</h5><p>Minutes</p>")).alias("html"))
    return g.historical_meetings(pages).groupBy("Year", "Month", "Day").agg(F.count("*").alias("n"))


@query("s21_rolling_meetings", """SELECT DISTINCT 2000 + year(o_orderdate) % 100 AS Year, month(o_orderdate)::INT AS Month, CASE WHEN day(o_orderdate) % 3 = 1 THEN day(o_orderdate) ELSE least(day(o_orderdate) + 1, 28) END::INT AS Day FROM orders""")
def rolling(spark, d):
    """Pages of a month each, with days written as 1-2*, 22 (notation vote) and 1-2 with a note behind, among lines that are none."""
    names = F.array(*(F.lit(m) for m in g.MONTHS))
    o = read(spark, d, "orders").select((F.lit(2000) + F.year("o_orderdate") % 100).alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d")).distinct()
    later = F.concat(F.lit("1-"), F.least(F.col("d") + 1, F.lit(28)).cast("string"))
    days = F.when(F.col("d") % 3 == 0, F.concat(later, F.lit("*"))).when(F.col("d") % 3 == 1, F.concat(F.col("d").cast("string"), F.lit(" (notation vote)"))).otherwise(F.concat(later, F.lit(" Statement")))
    text = F.concat_ws("\n", F.concat(F.col("y").cast("string"), F.lit(" FOMC Meetings")), F.get(names, F.col("m") - 1), days, F.lit("Statement: PDF"))
    pages = o.select(F.concat_ws("-", "y", "m", "d").alias("page"), text.alias("text"))
    return g.assemble_calendar(g.rolling_meetings(pages))
