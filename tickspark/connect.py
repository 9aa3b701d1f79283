"""The Python surface: a connection whose results become pandas, polars, numpy, Arrow or dicts, and an engine over tick storage.

Results that a converter holds are the caller's to bound: `Result.frame` is the lazy DataFrame. Frames
come in whatever they are: Spark's, pandas', polars' or Arrow tables.
"""

from __future__ import annotations

import time
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.functions.scalars import vwap
from tickspark.operators import relational
from tickspark.plans import ddl, dialect
from tickspark.sources import store

#: The dialect's and other usual type names to Arrow; a name that is none of them is read as float64.
ARROW_TYPES = {
    "BOOLEAN": pa.bool_(),
    "TINYINT": pa.int8(),
    "SMALLINT": pa.int16(),
    "INT": pa.int32(),
    "BIGINT": pa.int64(),
    "SYMBOL": pa.int64(),
    "FLOAT": pa.float32(),
    "DOUBLE": pa.float64(),
    "VARCHAR": pa.string(),
    "DATE": pa.date32(),
    "TIMESTAMP": pa.timestamp("ns", "UTC"),
}


def arrow_schema(columns: dict[str, str]) -> pa.Schema:
    """Columns of type names as an Arrow schema; aliases of the dialect's DDL count as their type."""

    def kind(name: str) -> pa.DataType:
        name = name.upper()
        if name in ("TIMESTAMP_NS", "TIMESTAMP"):
            return ARROW_TYPES["TIMESTAMP"]
        return ARROW_TYPES.get(name) or ARROW_TYPES.get(ddl.TYPES.get(name, ""), pa.float64())

    return pa.schema([(c, kind(t)) for c, t in columns.items()])


def infer_schema(frame: Any) -> dict[str, str]:
    """Columns and the dialect's type names of a frame of any kind."""
    names = {T.BooleanType: "BOOLEAN", T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INT", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP"}
    if isinstance(frame, DataFrame):
        return {f.name: names.get(type(f.dataType), f.dataType.simpleString().upper()) for f in frame.schema}
    by_arrow = {str(t): n for n, t in ARROW_TYPES.items() if n != "SYMBOL"} | {"large_string": "VARCHAR", "string_view": "VARCHAR"}
    schema = (frame if isinstance(frame, pa.Table) else _arrow(frame)).schema
    return {f.name: "TIMESTAMP" if pa.types.is_timestamp(f.type) else by_arrow.get(str(f.type), str(f.type).upper()) for f in schema}


def _arrow(frame: Any) -> pa.Table:
    if isinstance(frame, pa.Table):
        return frame
    if isinstance(frame, pa.RecordBatch):
        return pa.Table.from_batches([frame])
    if hasattr(frame, "to_arrow"):  # polars
        return frame.to_arrow()
    return pa.Table.from_pandas(frame, preserve_index=False)


def to_spark(spark: SparkSession, frame: Any) -> DataFrame:
    """A frame of any kind as Spark's; times become nanoseconds, since Spark's own are coarser."""
    if isinstance(frame, DataFrame):
        return frame
    table = _arrow(frame)
    for i, f in enumerate(table.schema):
        if pa.types.is_timestamp(f.type):
            table = table.set_column(i, f.name, table.column(i).cast(pa.timestamp("ns", f.type.tz)).cast(pa.int64()))
        elif pa.types.is_unsigned_integer(f.type):
            table = table.set_column(i, f.name, table.column(i).cast(pa.int64()))
    return spark.createDataFrame(table)


class Result:
    def __init__(self, frame: DataFrame, seconds: float = 0.0):
        self.frame, self.columns, self.seconds = frame, frame.columns, seconds

    def to_arrow(self) -> pa.Table:
        return self.frame.toArrow()

    def to_pandas(self) -> Any:
        return self.frame.toPandas()

    def to_polars(self) -> Any:
        import polars

        return polars.from_arrow(self.to_arrow())

    def to_numpy(self) -> dict[str, Any]:
        return {c: x.to_numpy(zero_copy_only=False) for c, x in zip(self.columns, (c.combine_chunks() for c in self.to_arrow().columns), strict=True)}

    def to_dict(self) -> dict[str, list]:
        return self.to_arrow().to_pydict()

    def __iter__(self) -> Any:
        return (tuple(r) for r in self.frame.toLocalIterator())


class Connection:
    """The dialect over a session. ingest appends frames to tick storage at `path`; its rows are the view `table`."""

    def __init__(self, spark: SparkSession, path: str | None = None, table: str = "trades"):
        self.spark, self.path, self.table = spark, path, table
        self.counts = {"queries": 0, "rows": 0, "failed": 0}

    def query(self, sql: str) -> Result:
        start = time.perf_counter()
        try:
            words = sql.split(None, 1)
            frame = ddl.execute(self.spark, sql) if words and words[0].upper() in ("CREATE", "DROP", "ALTER") else dialect.sql(self.spark, sql.rstrip().rstrip(";"))
        except Exception:
            self.counts["failed"] += 1
            raise
        self.counts["queries"] += 1
        return Result(self.spark.createDataFrame([], "ok boolean") if frame is None else frame, time.perf_counter() - start)

    execute = query

    def query_pandas(self, sql: str) -> Any:
        return self.query(sql).to_pandas()

    def query_polars(self, sql: str) -> Any:
        return self.query(sql).to_polars()

    def query_numpy(self, sql: str) -> dict[str, Any]:
        return self.query(sql).to_numpy()

    def ingest(self, frame: Any, **columns: Any) -> int:
        """Appends ticks; columns: what from_columns takes (symbol, price, volume, time, price_scale). Returns the rows."""
        if self.path is None:
            raise ValueError("a connection without a path takes no ticks")
        rows = store.from_columns(to_spark(self.spark, frame), **columns)
        n = rows.count()
        store.write_ticks(rows, self.path)
        store.read_ticks(self.spark, self.path).createOrReplaceTempView(self.table)
        self.counts["rows"] += n
        return n

    ingest_pandas = ingest_polars = ingest_arrow = ingest

    def ping(self) -> bool:
        return self.spark.range(1).count() == 1

    def health(self) -> dict[str, str]:
        return {"status": "ok" if self.ping() else "down"}

    def stats(self) -> dict[str, int]:
        return dict(self.counts)


class Engine:
    """Point queries over tick storage, and ticks that wait until drain() stores them."""

    def __init__(self, spark: SparkSession, path: str, batch: int = 100_000):
        self.spark, self.path, self.batch = spark, path, batch
        self.waiting: list[tuple[int, int, int, int]] = []
        self.seq, self.stored = 0, 0

    def ingest(self, symbol: int, price: int, volume: int, timestamp: int | None = None) -> None:
        self.waiting.append((symbol, time.time_ns() if timestamp is None else timestamp, price, volume))
        if len(self.waiting) >= self.batch:
            self.drain()

    def ingest_batch(self, symbols: Any, prices: Any, volumes: Any, timestamps: Any = None, price_scale: float = 1.0) -> None:
        """Columns of equal length; float prices are scaled and cut to whole numbers."""
        now = time.time_ns()
        times = [now] * len(symbols) if timestamps is None else timestamps
        for s, t, p, v in zip(symbols, times, prices, volumes, strict=True):
            self.ingest(int(s), int(p * price_scale), int(v), int(t))

    def drain(self) -> int:
        """Stores what waits; returns how many ticks are stored."""
        if self.waiting:
            rows = [(s, t, p, v, self.seq + i) for i, (s, t, p, v) in enumerate(self.waiting)]
            store.write_ticks(self.spark.createDataFrame(rows, "symbol long, timestamp long, price long, volume long, seq long"), self.path)
            self.seq, self.stored, self.waiting = self.seq + len(rows), self.stored + len(rows), []
        return self.stored

    def rows(self, symbol: int, start: int = 0, end: int = 2**62) -> DataFrame:
        self.drain()
        return store.read_ticks(self.spark, self.path, symbol, start, end)

    def vwap(self, symbol: int, start: int = 0, end: int = 2**62) -> float | None:
        return self.rows(symbol, start, end).agg(vwap("price", "volume")).first()[0]

    def filter_sum(self, symbol: int, column: str, above: int, start: int = 0, end: int = 2**62) -> int:
        return relational.point_filter_sum(self.rows(symbol, start, end), symbol, column, above, start, end).first()[0]

    def count(self, symbol: int, start: int = 0, end: int = 2**62) -> int:
        return self.rows(symbol, start, end).count()

    def column(self, symbol: int, name: str) -> Any:
        """A column of a symbol in order of time, as an array of the driver."""
        return self.rows(symbol).orderBy("timestamp", "seq").select(F.col(name)).toArrow().column(0).combine_chunks().to_numpy()

    def stats(self) -> dict[str, int]:
        return {"stored": self.stored, "waiting": len(self.waiting)}
