"""Views of the test tables in the shape of market ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(column: str) -> F.Column:
    """Nanoseconds since the epoch of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column}) * 1000")


def _instant(micros: int) -> F.Column:
    return F.expr(f"timestampadd(MICROSECOND, {micros}, timestamp_ntz'1970-01-01 00:00:00')")


def ticks(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """symbol, timestamp (ns), price, volume, seq, kind of every event; a time range is one of the file's own column, so that Parquet skips what lies outside."""
    events = table(spark, sf_dir, "events")
    if start is not None:
        events = events.where(F.col("ts") >= _instant(-(-start // 1000)))
    if end is not None:
        events = events.where(F.col("ts") <= _instant(end // 1000))
    return events.select(
        F.col("user_id").alias("symbol"), nanos("ts").alias("timestamp"), F.round(F.col("value") * 100).cast("long").alias("price"), (F.col("event_id") % 100 + 1).alias("volume"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind")
    )


def trades(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    return ticks(spark, sf_dir, start, end).where("kind = 'purchase'").drop("kind")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where("kind in ('view', 'click')").select("symbol", "timestamp", F.col("price").alias("bid"), (F.col("price") + 1).alias("ask"), "seq")
