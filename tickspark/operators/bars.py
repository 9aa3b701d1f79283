"""Bars: time buckets with ordered and weighted aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.functions.scalars import first_by, last_by, vwap, xbar


def ohlcv(ticks: DataFrame, bucket: int, keys: Sequence[str] = ("symbol",), time: str = "timestamp", price: str = "price", volume: str = "volume", ties: Sequence[str] = ("seq",)) -> DataFrame:
    """open, high, low, close, volume, vwap per keys and bucket, in one partial and final aggregation."""
    order = (time, *ties)
    return ticks.groupBy(*keys, xbar(time, bucket).alias("bar")).agg(first_by(price, *order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), last_by(price, *order).alias("close"), F.sum(volume).alias("volume"), vwap(price, volume).alias("vwap"))
