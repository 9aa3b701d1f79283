"""Set operations that keep left duplicates, and point queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame) -> Column:
    match = F.lit(True)
    for a, b in zip(left.columns, right.columns, strict=True):
        match = match & left[a].eqNullSafe(right[b])
    return match


def intersect_keeping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows that the right side has, each as often as on the left; nulls are equal."""
    right = right.toDF(*(f"r_{i}" for i in range(len(right.columns))))
    return left.join(right, _same(left, right), "left_semi")


def except_keeping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows that the right side lacks, each as often as on the left; nulls are equal."""
    right = right.toDF(*(f"r_{i}" for i in range(len(right.columns))))
    return left.join(right, _same(left, right), "left_anti")


def _between(ticks: DataFrame, symbol: int, start: int, end: int) -> DataFrame:
    return ticks.where((F.col("symbol") == symbol) & F.col("timestamp").between(start, end))


def point_vwap(ticks: DataFrame, symbol: int, start: int, end: int) -> DataFrame:
    """vwap, n of a symbol's rows in [start, end]; 0 without volume, null without rows."""
    total = F.sum(F.col("volume"))
    return _between(ticks, symbol, start, end).agg(F.when(F.count("*") == 0, None).when(total == 0, 0.0).otherwise(F.sum(F.col("price") * F.col("volume")) / F.nullif(total, F.lit(0))).alias("vwap"), F.count("*").alias("n"))


def point_filter_sum(ticks: DataFrame, symbol: int, column: str, above: int, start: int, end: int) -> DataFrame:
    """total of a column's values above a bound."""
    return _between(ticks, symbol, start, end).where(F.col(column) > above).agg(F.coalesce(F.sum(column), F.lit(0)).alias("total"))


def point_count(ticks: DataFrame, symbol: int, start: int, end: int) -> DataFrame:
    return _between(ticks, symbol, start, end).agg(F.count("*").alias("n"))
