"""Decoders of binary messages, as column expressions: ITCH orders and trades, and the 64-byte tick record."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_UNIT = 10_000
#: Length of a message after its type, with six bytes of time.
ITCH_BODY = {"A": 35, "E": 30, "P": 43}
#: Kinds of the tick record.
TICK_KINDS = ("trade", "bid", "ask")
TICK_BYTES = 64


def big_endian(message: Column, at: Column | int, size: Column | int) -> Column:
    """An unsigned number whose first byte is at the 0-based place; null if it doesn't fit a long."""
    at, size = (F.lit(x) if isinstance(x, int) else x for x in (at, size))
    return F.conv(F.hex(F.substring(message, at + 1, size)), 16, 10).try_cast("bigint")


def little_endian(message: Column, at: int, size: int) -> Column:
    """A number of size bytes; eight bytes are signed."""
    reverse = F.concat(*(F.hex(F.substring(message, at + i + 1, 1)) for i in reversed(range(size))))
    return F.conv(reverse, 16, -10).try_cast("bigint")


def itch_ticks(messages: DataFrame, value: str = "value") -> DataFrame:
    """Ticks of ITCH messages: two bytes of length, a type, then the body. Times may have six or eight bytes; the body's length says which.

    kind is order (A) or trade (P, E); an execution (E) names its order and has neither symbol nor
    price. Messages of other types, and ones too short for theirs, give kind null, so that a filter on
    it sends them elsewhere.
    """
    m = F.col(value).cast("binary")
    kind = F.decode(F.substring(m, 3, 1), "ISO-8859-1")
    least = F.when(kind == "A", ITCH_BODY["A"]).when(kind == "P", ITCH_BODY["P"]).when(kind == "E", ITCH_BODY["E"])
    body = F.octet_length(m) - 3
    clock = F.when(body >= least + 2, 8).when(body >= least, 6)
    order_at = clock + 7
    traded = kind.isin("A", "P")
    size_at = order_at + F.when(traded, 9).otherwise(8)
    letters = F.rtrim(F.decode(F.substring(m, size_at + 5, F.lit(8)), "ISO-8859-1"))
    side = F.decode(F.substring(m, order_at + 9, F.lit(1)), "ISO-8859-1")
    fits = clock.isNotNull()
    return messages.select(
        F.when(fits, F.when(kind == "A", "order").otherwise("trade")).alias("kind"),
        F.when(fits & traded, letters).alias("symbol"),
        F.when(fits, big_endian(m, F.lit(7), clock)).alias("timestamp"),
        F.when(fits & traded, big_endian(m, size_at + 12, 4) / PRICE_UNIT).alias("price"),
        F.when(fits, big_endian(m, size_at, 4)).alias("volume"),
        F.when(fits & traded, F.when(side == "B", "buy").when(side == "S", "sell")).alias("side"),
        F.when(fits, F.conv(F.hex(F.substring(m, order_at + 1, F.lit(8))), 16, 10)).alias("order_id"),
    )


def framed_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of files in which each has its length (of type and body, two bytes) before it, in file order as `place`.

    A file is read by one task, so a day's capture should lie in files of some hundred megabytes. A
    last message that the file cuts short is dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                at, places, values = 0, [], []
                while at + 2 <= len(content) and (end := at + 2 + int.from_bytes(content[at : at + 2])) <= len(content):
                    places.append(at)
                    values.append(content[at:end])
                    at = end
                    if len(values) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(places, pa.int64()), pa.array(values, pa.binary())], names=["path", "place", "value"])
                        places, values = [], []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.binary())], names=["path", "place", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, place long, value binary")


def tick_records(messages: DataFrame, value: str = "value") -> DataFrame:
    """Rows of 64-byte little-endian records: seq, timestamp, symbol (four bytes, four unused), price, volume, kind. Records of another length get kind null."""
    m = F.col(value).cast("binary")
    fits = F.octet_length(m) == TICK_BYTES
    number = lambda at, size=8: F.when(fits, little_endian(m, at, size))
    kind = F.get(F.array(*map(F.lit, TICK_KINDS)), little_endian(m, 40, 1).cast("int"))
    return messages.select(number(16, 4).alias("symbol"), number(8).alias("timestamp"), number(24).alias("price"), number(32).alias("volume"), number(0).alias("seq"), F.when(fits, kind).alias("kind"))
