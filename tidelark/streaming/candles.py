"""Landed candle payloads as a stream: each batch is decoded and committed to the versioned bar store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import ingest, store


def candle_stream(spark: SparkSession, landing: str, late: str = "2 days") -> DataFrame:
    """Bars of JSON payloads as they land, one a symbol and time within the watermark."""
    raw = spark.readStream.schema(ingest.CANDLES).json(landing)
    return ingest.decode_candles(raw).withWatermark("dt", late).dropDuplicatesWithinWatermark(["symbol", "dt"])


def store_candles(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Commits every batch to the versioned store under the name of its checkpoint and number: a batch that is run again changes nothing, and stored bars win over new ones."""

    def put(batch: DataFrame, number: int) -> None:
        store.add_bars(batch, path, f"{checkpoint}#{number}")

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
