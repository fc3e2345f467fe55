"""What the operators need, derived from the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """(symbol, date, price): six symbols by return flag and status, averaged by week or day."""
    li = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.date_trunc(unit, "l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    return li.groupBy("symbol", "date").agg(F.round(F.avg("u"), 6).alias("price"))


PRICES_SQL = """prices AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date,
 round(avg(l_extendedprice / l_quantity), 6) AS price FROM lineitem GROUP BY 1, 2)"""


def bars(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """(symbol, dt, open, high, low, close, volume) of the events of each type."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc(unit, "ts").alias("dt"), "value", F.struct("ts", "event_id").alias("o"))
    return e.groupBy("symbol", "dt").agg(F.min_by("value", "o").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "o").alias("close"), F.count("*").alias("volume"))


BARS_SQL = """bars AS (SELECT event_type AS symbol, date_trunc('{unit}', ts) AS dt, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""
