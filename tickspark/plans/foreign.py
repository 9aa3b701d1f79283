"""Text for other databases: tables from Spark schemas, retention, rollups, export, load and the dialect's query functions.

Only text is made; nothing here connects anywhere. Targets are clickhouse, duckdb and timescale.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import types as T

from tickspark.plans.dialect import split_arguments

TARGETS = ("clickhouse", "duckdb", "timescale")
#: Each target's name of a Spark type.
TYPES: dict[type, tuple[str, str, str]] = {
    T.BooleanType: ("UInt8", "BOOLEAN", "BOOLEAN"),
    T.ByteType: ("Int8", "TINYINT", "SMALLINT"),
    T.ShortType: ("Int16", "SMALLINT", "SMALLINT"),
    T.IntegerType: ("Int32", "INTEGER", "INTEGER"),
    T.LongType: ("Int64", "BIGINT", "BIGINT"),
    T.FloatType: ("Float32", "FLOAT", "REAL"),
    T.DoubleType: ("Float64", "DOUBLE", "DOUBLE PRECISION"),
    T.StringType: ("String", "VARCHAR", "TEXT"),
    T.BinaryType: ("String", "BLOB", "BYTEA"),
    T.DateType: ("Date32", "DATE", "DATE"),
    T.TimestampType: ("DateTime64(9, 'UTC')", "TIMESTAMPTZ", "TIMESTAMPTZ"),
    T.TimestampNTZType: ("DateTime64(9, 'UTC')", "TIMESTAMP", "TIMESTAMP"),
}
#: Columns of this library's ticks, quotes and book levels, with names for symbols and times as other databases have them.
_market = {
    "trades": "timestamp timestamp, sym string, price double, size double, side tinyint, seq bigint, venue string",
    "quotes": "timestamp timestamp, sym string, bid double, bid_size double, ask double, ask_size double, seq bigint, venue string",
    "orderbook": "timestamp timestamp, sym string, seq bigint, level tinyint, side tinyint, price double, size double",
}


def market_schema(name: str) -> T.StructType:
    """The columns of trades, quotes or orderbook."""
    kinds = {"timestamp": T.TimestampType(), "string": T.StringType(), "double": T.DoubleType(), "tinyint": T.ByteType(), "int": T.IntegerType(), "bigint": T.LongType()}
    return T.StructType([T.StructField(column, kinds[kind]) for column, kind in (x.split() for x in _market[name].split(", "))])


def _target(target: str) -> int:
    if target not in TARGETS:
        raise ValueError(f"a target is one of {', '.join(TARGETS)}")
    return TARGETS.index(target)


def quoted(name: str, target: str) -> str:
    return f"`{name.replace('`', '``')}`" if target == "clickhouse" else '"' + name.replace('"', '""') + '"'


def literal(value: object, target: str) -> str:
    """A value as text; a backslash escapes in clickhouse alone."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, int | float) else "'" + (str(value).replace("\\", "\\\\") if target == "clickhouse" else str(value)).replace("'", "''") + "'"


def type_name(kind: T.DataType, target: str) -> str:
    at = _target(target)
    if isinstance(kind, T.DecimalType):
        return f"{'NUMERIC' if target == 'timescale' else 'Decimal'}({kind.precision}, {kind.scale})"
    if isinstance(kind, T.ArrayType):
        inner = type_name(kind.elementType, target)
        return f"Array({inner})" if target == "clickhouse" else f"{inner}[]"
    if type(kind) not in TYPES:
        raise ValueError(f"{kind.simpleString()} has no counterpart in {target}")
    return TYPES[type(kind)][at]


def create_table(name: str, schema: T.StructType, target: str, order_by: Sequence[str] = ("sym", "timestamp"), time: str = "timestamp", ttl_days: int | None = None) -> str:
    """A table; on clickhouse with the sort order, monthly parts and TTL that hold it."""
    lines = []
    for f in schema.fields:
        kind = type_name(f.dataType, target)
        if target == "clickhouse":
            if isinstance(f.dataType, T.StringType):
                kind = f"LowCardinality({kind})"
            elif f.nullable and f.name not in order_by and f.name != time and not isinstance(f.dataType, T.ArrayType):
                kind = f"Nullable({kind})"
        lines.append(f"  {quoted(f.name, target)} {kind}" + ("" if target == "clickhouse" or f.nullable else " NOT NULL"))
    text = f"CREATE TABLE IF NOT EXISTS {name} (\n" + ",\n".join(lines) + "\n)"
    if target == "clickhouse":
        text += f"\nENGINE = MergeTree\nPARTITION BY toYYYYMM({quoted(time, target)})\nORDER BY ({', '.join(quoted(c, target) for c in order_by)})"
        if ttl_days:
            text += f"\nTTL toDateTime({quoted(time, target)}) + INTERVAL {ttl_days} DAY"
    return text + ";"


def hypertable(name: str, time: str = "timestamp", chunk_days: int = 1, segment_by: Sequence[str] = ("sym",), compress_days: int | None = 7, retain_days: int | None = None) -> list[str]:
    """Statements that make a timescale table chunked by time, compressed by key and bounded in age."""
    out = [f"SELECT create_hypertable('{name}', '{time}', chunk_time_interval => INTERVAL '{chunk_days} days', if_not_exists => TRUE);"]
    if compress_days:
        out.append(f"ALTER TABLE {name} SET (timescaledb.compress, timescaledb.compress_segmentby = '{', '.join(segment_by)}', timescaledb.compress_orderby = '{time} DESC');")
        out.append(f"SELECT add_compression_policy('{name}', INTERVAL '{compress_days} days');")
    if retain_days:
        out.append(f"SELECT add_retention_policy('{name}', INTERVAL '{retain_days} days');")
    return out


def continuous_bars(name: str, table: str, bucket: str = "5 minutes", time: str = "timestamp", key: str = "sym", lag: str = "1 minute", every: str = "5 minutes") -> list[str]:
    """A timescale rollup of bars and the policy that keeps it fresh."""
    select = f"SELECT time_bucket(INTERVAL '{bucket}', {time}) AS bucket, {key}, first(price, {time}) AS open, max(price) AS high, min(price) AS low, last(price, {time}) AS close, sum(size) AS volume FROM {table} GROUP BY bucket, {key}"
    return [f"CREATE MATERIALIZED VIEW {name} WITH (timescaledb.continuous) AS {select} WITH NO DATA;", f"SELECT add_continuous_aggregate_policy('{name}', start_offset => INTERVAL '30 days', end_offset => INTERVAL '{lag}', schedule_interval => INTERVAL '{every}');"]


def asof(left: str, right: str, keys: Sequence[str], time: str, columns: Sequence[str], target: str) -> str:
    """Each left row with the right row of its keys that is the latest at its time or before."""
    _target(target)
    same = " AND ".join(f"l.{k} = r.{k}" for k in keys)
    if target == "timescale":
        return f"SELECT l.*, {', '.join(f'r.{c}' for c in columns)} FROM {left} l CROSS JOIN LATERAL (SELECT * FROM {right} r WHERE {same} AND r.{time} <= l.{time} ORDER BY r.{time} DESC LIMIT 1) r"
    return f"SELECT l.*, {', '.join(f'r.{c}' for c in columns)} FROM {left} l ASOF JOIN {right} r ON {same} AND l.{time} >= r.{time}"


def insert_values(name: str, columns: Sequence[str], rows: Iterable[Sequence[object]], target: str) -> str:
    """One INSERT of a few rows; move large tables as Parquet."""
    _target(target)
    return f"INSERT INTO {name} ({', '.join(quoted(c, target) for c in columns)}) VALUES\n" + ",\n".join("(" + ", ".join(literal(x, target) for x in r) + ")" for r in rows) + ";"


def copy_parquet(query: str, path: str, partition_by: Sequence[str] = (), compression: str = "zstd") -> str:
    """DuckDB's export of a query as Parquet, in Hive folders if partitions are named."""
    parts = f", PARTITION_BY ({', '.join(partition_by)}), OVERWRITE_OR_IGNORE" if partition_by else ""
    return f"COPY ({query}) TO {literal(path, "duckdb")} (FORMAT PARQUET, COMPRESSION {compression}{parts});"


def parquet_view(name: str, path: str, target: str = "duckdb") -> str:
    """A view over Parquet folders that Spark wrote with partitionBy."""
    if target == "clickhouse":
        return f"CREATE VIEW {name} AS SELECT * FROM file({literal(path + '/**/*.parquet', "clickhouse")}, Parquet);"
    if target != "duckdb":
        raise ValueError("timescale reads no Parquet")
    return f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet({literal(path + '/**/*.parquet', "duckdb")}, hive_partitioning = true);"


def _call(name: str, args: list[str], target: str, time: str) -> str | None:
    if name == "xbar":
        column, width = args
        if re.fullmatch(r"\d+", width) and int(width) % 1_000_000_000 == 0:
            seconds = int(width) // 1_000_000_000
            return f"toStartOfInterval({column}, INTERVAL {seconds} SECOND)" if target == "clickhouse" else f"time_bucket(INTERVAL '{seconds} seconds', {column})"
        return f"intDiv({column}, {width}) * {width}" if target == "clickhouse" else f"({column} // {width}) * {width}" if target == "duckdb" else f"({column} / {width}) * {width}"
    if name in ("first", "last") and len(args) == 1:
        if target == "timescale":
            return f"{name}({args[0]}, {time})"
        low = name == "first"
        return f"{('argMin' if low else 'argMax') if target == 'clickhouse' else ('arg_min' if low else 'arg_max')}({args[0]}, {time})"
    if name == "vwap":
        return f"sum({args[0]} * {args[1]}) / nullif(sum({args[1]}), 0)"
    return None


def query_text(sql: str, target: str, time: str = "timestamp") -> str:
    """The dialect's xbar, first, last and vwap in the target's functions; text in quotes stays. xbar's width is in nanoseconds, the time column a timestamp where it is whole seconds."""
    _target(target)
    out, at = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\b(xbar|first|last|vwap)\s*\(", sql, re.I):
        if m.start() < at or not m[1]:
            continue
        depth, end = 1, m.end()
        while depth and end < len(sql):
            if sql[end] == "'":
                end = sql.index("'", end + 1)
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if depth:
            raise ValueError(f"a parenthesis is open in {sql[m.start():]}")
        args = [query_text(a.strip(), target, time) for a in split_arguments(sql[m.end() : end - 1])]
        made = _call(m[1].lower(), args, target, time)
        if made:
            out += [sql[at : m.start()], made]
            at = end
    return "".join(out) + sql[at:]
