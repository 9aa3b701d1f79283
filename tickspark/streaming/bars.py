"""Bars over a stream, and hours sealed as the watermark passes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickspark.operators.bars import ohlcv


def event_time(ticks: DataFrame, time: str = "timestamp") -> DataFrame:
    return ticks.withColumn("event_time", F.timestamp_micros(F.call_function("div", F.col(time), F.lit(1000))))


def running_bars(ticks: DataFrame, bucket: int) -> DataFrame:
    """Bars of all rows so far, for update or complete output: equal to the batch query at any time."""
    return ohlcv(ticks, bucket)


def sealed_bars(ticks: DataFrame, bucket: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Each bar once, when the watermark passes its end; rows later than that are dropped, which bounds the state."""
    order = F.struct("timestamp", "seq")
    return event_time(ticks).withWatermark("event_time", late).groupBy("symbol", F.window("event_time", bucket)).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))


def ingest(ticks: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Appends a stream to tick storage, each batch under its number so that a repeated one replaces itself."""
    from tickspark.sources.store import write_ticks

    def sink(batch: DataFrame, number: int) -> None:
        write_ticks(batch, f"{path}/batch={number}", buckets, mode="overwrite")

    return ticks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
