"""Readers and keepers of market data: typed files, meeting pages, conversion-factor sheets and the bar store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import mixed_fraction
from . import store

#: Schemas of the files; what is missing is NULL.
EQUITIES = "trading_date DATE, ric STRING, last DOUBLE, volume DOUBLE"
FUTURES = "obs_date DATE, px_ident STRING, maturity STRING, price DOUBLE"
SPEC = "multiplier DOUBLE, tick_size DOUBLE, tick_value DOUBLE, asset_class STRING"
POSITION = "book_id STRING, pos_no INT, type STRING, symbol STRING, quantity DOUBLE, trade_price DOUBLE, strike DOUBLE, expiry DATE, expiry_days INT, option_type STRING, underlying_type STRING, underlying_symbol STRING, q DOUBLE, vol DOUBLE, rate DOUBLE, open BOOLEAN"
INSTRUMENTS = "curve_id STRING, trade_date DATE, symbol STRING, tenor STRING, type STRING, quote DOUBLE"
YIELDS = "date DATE, y5 DOUBLE, y30 DOUBLE"
CANDLES = "symbol STRING, candles ARRAY<STRUCT<datetime: BIGINT, open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, volume: BIGINT>>"
#: Month names and their numbers.
MONTHS = {"January": 1, "February": 2, "March": 3, "April": 4, "May": 5, "June": 6, "July": 7, "August": 8, "September": 9, "October": 10, "November": 11, "December": 12}
NAMES = "|".join(MONTHS)


def _month(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for p in MONTHS.items() for x in p))[name]


def read_equities(spark: SparkSession, path: str) -> DataFrame:
    """Prices without the exchange suffix of the symbol. A missing path is an error."""
    return spark.read.schema(EQUITIES).csv(path, header=True).withColumn("ric", F.substring_index("ric", ".", 1))


def read_futures(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a pattern, with file for rules that keep the first."""
    return spark.read.schema(FUTURES).csv(pattern, header=True).select("*", F.col("_metadata.file_name").alias("file"))


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object from symbols to specs -> (symbol, multiplier, tick_size, tick_value, asset_class)."""
    text = spark.read.text(path, wholetext=True)
    m = text.select(F.explode(F.from_json("value", f"MAP<STRING, STRUCT<{SPEC.replace(' DOUBLE', ': DOUBLE').replace(' STRING', ': STRING')}>>")).alias("symbol", "s"))
    return m.select("symbol", "s.*")


def specs_with_defaults(symbols: DataFrame, specs: DataFrame, multiplier: float = 1.0, tick: float = 1.0) -> DataFrame:
    """symbols with their specs; a symbol without any has the defaults, their product as tick value, and class Unknown."""
    j = symbols.join(specs, "symbol", "left")
    m, t = F.coalesce("multiplier", F.lit(multiplier)), F.coalesce("tick_size", F.lit(tick))
    return j.select(*(c for c in symbols.columns), m.alias("multiplier"), t.alias("tick_size"), F.coalesce("tick_value", m * t).alias("tick_value"), F.coalesce("asset_class", F.lit("Unknown")).alias("asset_class"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSITION).json(path, multiLine=True)


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """Quotes of curves; rows without a type are left out."""
    return spark.read.schema(INSTRUMENTS).csv(path, header=True).na.drop(subset=["type"])


def read_auctions(spark: SparkSession, path: str) -> DataFrame:
    """Auction results from text columns: $1,234 money, 3.500% coupons and MM/dd/yyyy dates."""
    return parse_auctions(spark.read.csv(path, header=True))


def parse_auctions(raw: DataFrame) -> DataFrame:
    names = ("cusip", "auction_date", "issue_date", "maturity_date", "price", "outstanding", "frequency", "coupon", "accepted")
    d = raw.toDF(*names)
    money = lambda c: F.regexp_replace(c, r"[$,\s]", "").try_cast("decimal(18,2)")
    day = lambda c: F.try_to_date(c, "MM/dd/yyyy")
    return d.select(F.trim("cusip").alias("cusip"), *(day(F.col(c)).alias(c) for c in names[1:4]), F.col("price").try_cast("decimal(12,6)").alias("price"), money(F.col("outstanding")).alias("outstanding"), "frequency", F.regexp_replace("coupon", "%", "").try_cast("double").alias("coupon"), money(F.col("accepted")).alias("accepted"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_yields(spark: SparkSession, pattern: str) -> DataFrame:
    """Yields of all files, the first row of each date by file and place."""
    d = spark.read.schema(YIELDS).csv(pattern, header=True).select("*", F.col("_metadata.file_name").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    return keep_first(d, ["date"], [F.col("_f"), F.col("_i")]).drop("_f", "_i")


def parse_etf(raw: DataFrame) -> DataFrame:
    """(trading_date, ric, last) with times written as 01/31/2024 04:00:00 PM."""
    return raw.withColumn("trading_date", F.try_to_timestamp("trading_date", F.lit("MM/dd/yyyy hh:mm:ss a")))


def meeting_calendar(raw: DataFrame, t0: str, explicit: list | None = None) -> DataFrame:
    """(meeting_date) not before t0, of year, month and day columns, or of an explicit list in their place."""
    if explicit is not None:
        d = raw.sparkSession.createDataFrame([(str(x),) for x in explicit], "d string").select(F.to_date("d").alias("meeting_date"))
    else:
        d = raw.select(F.make_date("Year", "Month", "Day").alias("meeting_date"))
    return d.where(F.col("meeting_date") >= F.to_date(F.lit(t0))).distinct()


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    return parse_symbols(spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()))


def parse_symbols(lines: DataFrame) -> DataFrame:
    """(ticker, symbol, description) of lines (value, pos) TICKER,/SYMBOL,text; # and blank lines are skipped, the last line of a ticker wins."""
    p = F.split(F.trim("value"), ",", 3)
    d = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#") & (F.size(p) >= 2))
    d = d.select(F.trim(p[0]).alias("ticker"), F.trim(p[1]).alias("symbol"), F.trim(F.get(p, F.lit(2))).alias("description"), "pos")
    return keep_first(d, ["ticker"], [F.desc("pos")]).drop("pos")


def decode_candles(payloads: DataFrame) -> DataFrame:
    """(symbol, dt, open, high, low, close, volume) of payloads (symbol, candles) whose times are epoch milliseconds."""
    c = payloads.select("symbol", F.explode("candles").alias("c"))
    return c.select("symbol", F.timestamp_millis("c.datetime").alias("dt"), "c.open", "c.high", "c.low", "c.close", "c.volume")


def contract_blocks(sheet: DataFrame) -> DataFrame:
    """sheet (sheet_id, pos, c1, c2, ...) with contract: the header row that a row stands under. Tentative headers open no block. No two rows of a sheet may share a pos."""
    head = F.upper("c1").contains("FUTURES CONTRACT") & ~F.upper("c1").contains("TENTATIVE")
    w = Window.partitionBy("sheet_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = sheet.withColumn("contract", F.last(F.when(head, F.col("c1")), ignorenulls=True).over(w))
    return d.where(F.col("contract").isNotNull() & ~F.coalesce(head, F.lit(False)))


def contract_block(sheet: DataFrame, keyword: str) -> DataFrame:
    """The rows of each sheet under the first header that holds the keyword, up to the next header; fails if a sheet has no such header."""
    blocks = contract_blocks(sheet)
    head = F.upper("c1").contains("FUTURES CONTRACT") & ~F.upper("c1").contains("TENTATIVE")
    first = sheet.groupBy("sheet_id").agg(F.min_by("c1", F.when(head & F.col("c1").contains(keyword), F.col("pos"))).alias("contract"))
    first = first.withColumn("contract", F.when(F.col("contract").isNull(), F.raise_error(F.lit(f"{keyword} contract not found."))).otherwise(F.col("contract")))
    return blocks.join(first, ["sheet_id", "contract"])


def clean_blocks(blocks: DataFrame, months: list[str]) -> DataFrame:
    """(contract, coupon, issue_date, maturity, cusip, issuance, delivery_month, cf) of the rows below each block's "Coupon" line.

    blocks: c2 the row's number, c3 the coupon, c4 issue date, c5 maturity, c6 cusip, c7 issuance, then one column a
    month, named as months. ----- and other text that isn't a number is NULL.
    """
    w = Window.partitionBy("sheet_id", "contract").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    d = blocks.withColumn("_below", F.max(F.trim("c3") == "Coupon").over(w)).where("_below AND c3 IS NOT NULL")
    d = d.withColumn("coupon", mixed_fraction(F.trim("c3")) / 100).where("coupon IS NOT NULL")
    base = d.select("contract", "coupon", F.try_to_date("c4", "MM/dd/yyyy").alias("issue_date"), F.try_to_date("c5", "MM/dd/yyyy").alias("maturity"), F.trim("c6").alias("cusip"), F.regexp_replace("c7", "[$,]", "").try_cast("double").alias("issuance"), *(F.col(f"`{m}`").try_cast("double").alias(m) for m in months))
    return base.unpivot([c for c in base.columns if c not in months], months, "delivery_month", "cf")


def coverage_gaps(symbols: DataFrame, bars: DataFrame, start: str, end: str) -> DataFrame:
    """(symbol, begin, finish): what is missing of [start, end] before and after each symbol's bars; all of it without bars. Holes inside don't count."""
    have = bars.groupBy("symbol").agg(F.min(F.to_date("dt")).alias("lo"), F.max(F.to_date("dt")).alias("hi"))
    s, e = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    d = symbols.select("symbol").join(have, "symbol", "left")
    gap = lambda a, z: F.struct(a.alias("begin"), z.alias("finish"))
    whole = F.when(F.col("lo").isNull(), gap(s, e))
    head = F.when(s < F.date_sub("lo", 1), gap(s, F.date_sub("lo", 1)))
    tail = F.when(e > F.date_add("hi", 1), gap(F.date_add("hi", 1), e))
    return d.select("symbol", F.explode(F.filter(F.array(whole, head, tail), lambda x: x.isNotNull())).alias("g")).select("symbol", "g.begin", "g.finish")


def upsert_bars(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored and new bars, one row a symbol and time: stored wins."""
    both = stored.withColumn("_r", F.lit(0)).unionByName(new.withColumn("_r", F.lit(1)))
    return keep_first(both, ["symbol", "dt"], [F.col("_r")]).drop("_r")


def in_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    return bars.where(F.col("dt").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def write_bars(bars: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """The bar store: files by symbol and year, so that a reader of either sees no other; only partitions that bars has are replaced.

    Of several bars of a symbol and time the first by `order` (all other columns, if it isn't given) is written.
    """
    d = keep_first(bars, ["symbol", "dt"], order or [F.col(c) for c in bars.columns if c not in ("symbol", "dt")])
    d = d.withColumn("year", F.year("dt")).repartition("symbol", "year").sortWithinPartitions("symbol", "year", "dt")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "year").parquet(path)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of a folder that write_bars made, or the last commit of a versioned store (sources.store)."""
    if store.is_store(spark, path):
        return store.snapshot(spark, path, symbol=symbol)
    d = spark.read.parquet(path).drop("year")
    return d if symbol is None else d.where(F.col("symbol") == symbol)


def historical_meetings(pages: DataFrame) -> DataFrame:
    """(Year, Month, Day) of every "Month d", "Month d-d" and "Month d-Month d" in pages (year, html); the last day counts."""
    text = F.regexp_replace("html", "<[^>]*>", " ")
    found = pages.select("year", F.explode(F.regexp_extract_all(text, F.lit(rf"(?:{NAMES})\s+\d{{1,2}}(?:\s*[-–]\s*(?:(?:{NAMES})\s+)?\d{{1,2}})?"), F.lit(0))).alias("x"))
    first, second = F.regexp_extract("x", rf"^({NAMES})", 1), F.regexp_extract("x", rf"[-–]\s*({NAMES})", 1)
    day = F.coalesce(F.regexp_extract("x", r"[-–]\s*\D*(\d{1,2})$", 1).try_cast("int"), F.regexp_extract("x", r"(\d{1,2})", 1).try_cast("int"))
    return found.select(F.col("year").alias("Year"), _month(F.when(second != "", second).otherwise(first)).alias("Month"), day.alias("Day"))


def rolling_meetings(pages: DataFrame) -> DataFrame:
    """(Year, Month, Day) of pages (page, text) whose lines set the year ("2026 FOMC Meetings", at the line's beginning), the month, and the days in turn.

    A line of days begins with a day or two days, such as "17-18*" or "22 (notation vote)"; the last of them counts, whatever follows.
    """
    lines = pages.select("page", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    year = F.regexp_extract("line", r"^(20\d\d) FOMC Meetings", 1).try_cast("int")
    month = F.when(F.col("line").rlike(rf"^({NAMES})$"), _month(F.col("line")))
    d = lines.withColumns({"y": F.last(year, ignorenulls=True).over(w), "m": F.last(month, ignorenulls=True).over(w)})
    day = F.when(year.isNull(), F.regexp_extract("line", r"^(?:\d+-)?(\d+)", 1).try_cast("int"))
    return d.withColumn("Day", day).where("Day IS NOT NULL AND y IS NOT NULL AND m IS NOT NULL").select(F.col("y").alias("Year"), F.col("m").alias("Month"), "Day")


def assemble_calendar(*parts: DataFrame) -> DataFrame:
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return d.distinct()
