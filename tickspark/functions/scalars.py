"""Scalar and aggregate functions on integer nanosecond time and integer prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds of a unit; weeks count from the epoch, so they start on Thursdays.
UNIT_NS = {
    "ns": 1,
    "us": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "min": 60_000_000_000,
    "hour": 3_600_000_000_000,
    "day": 86_400_000_000_000,
    "week": 604_800_000_000_000,
}


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: Column | str, b: Column | str | int) -> Column:
    """Integer division toward zero; 0 where the divisor is 0."""
    a, b = _column(a), _column(b) if isinstance(b, (Column, str)) else F.lit(b)
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0))))


def xbar(x: Column | str, bucket: int) -> Column:
    """The bucket's start, counted from 0 toward zero."""
    return F.call_function("div", _column(x), F.lit(bucket)) * bucket


def date_trunc_ns(unit: str, x: Column | str) -> Column:
    return xbar(x, UNIT_NS[unit.lower()]) if unit.lower() in UNIT_NS else _column(x)


def epoch_s(x: Column | str) -> Column:
    return F.call_function("div", _column(x), F.lit(UNIT_NS["s"]))


def epoch_ms(x: Column | str) -> Column:
    return F.call_function("div", _column(x), F.lit(UNIT_NS["ms"]))


def now_ns() -> Column:
    """One instant per query."""
    return F.unix_micros(F.current_timestamp()) * 1000


def substr_int(x: Column | str, start: int, length: int | None = None) -> Column:
    """A substring of the decimal digits, as a number; 0 where it isn't one."""
    digits = _column(x).cast("string")
    part = F.substring(digits, max(start, 1), length if length is not None else 2**31 - 1)
    return F.coalesce(part.try_cast("bigint"), F.lit(0).cast("long"))


def like_int(x: Column | str, pattern: str) -> Column:
    return _column(x).cast("string").like(pattern)


def vwap(price: Column | str, volume: Column | str) -> Column:
    """Volume-weighted price; null unless the volume is positive. A ratio of two sums, so partial sums combine."""
    price, volume = _column(price), _column(volume)
    return F.when(F.sum(volume) > 0, F.sum(price * volume) / F.sum(volume))


def first_by(x: Column | str, *order: str) -> Column:
    return F.min_by(_column(x), F.struct(*order))


def last_by(x: Column | str, *order: str) -> Column:
    return F.max_by(_column(x), F.struct(*order))
