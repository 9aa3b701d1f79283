"""Tables in Spark's catalog with the dialect's types, and retention by age of their hours.

A table made with PARTITIONED BY (hour), a column of hour starts in nanoseconds, loses expired hours as
folders, without a row being read; other tables are written anew.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
#: The dialect's type names.
TYPES = {"INT32": "INT", "INT": "INT", "INT64": "BIGINT", "BIGINT": "BIGINT", "LONG": "BIGINT", "FLOAT32": "FLOAT", "FLOAT": "FLOAT", "REAL": "FLOAT", "FLOAT64": "DOUBLE", "DOUBLE": "DOUBLE", "TIMESTAMP": "BIGINT", "TIMESTAMP_NS": "BIGINT", "SYMBOL": "BIGINT", "BOOL": "BOOLEAN", "BOOLEAN": "BOOLEAN"}


def spark_type(name: str) -> str:
    if name.upper() not in TYPES:
        raise ValueError(f"unknown type {name}")
    return TYPES[name.upper()]


def execute(spark: SparkSession, text: str, now_ns: int | None = None) -> DataFrame | None:
    """CREATE, DROP and ALTER TABLE of the dialect. ALTER … SET TTL stores the limit and drops older hours."""
    text = text.strip().rstrip(";")
    if m := re.fullmatch(r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*?)\)(?:\s*PARTITIONED\s+BY\s*\(([\w\s,]+)\))?", text, re.I | re.S):
        columns = ", ".join(f"`{name}` {spark_type(kind)}" for name, kind in (x.split() for x in m[3].split(",")))
        return spark.sql(f"CREATE TABLE {m[1] or ''}{m[2]} ({columns}) USING parquet{f' PARTITIONED BY ({m[4]})' if m[4] else ''}")
    if m := re.fullmatch(r"ALTER\s+TABLE\s+(\w+)\s+ADD\s+(?:COLUMN\s+)?(\w+)\s+(\w+)", text, re.I):
        return spark.sql(f"ALTER TABLE {m[1]} ADD COLUMNS (`{m[2]}` {spark_type(m[3])})")
    if m := re.fullmatch(r"ALTER\s+TABLE\s+(\w+)\s+DROP\s+(?:COLUMN\s+)?(\w+)", text, re.I):
        table = spark.table(m[1])
        if m[2] not in table.columns:
            raise ValueError(f"{m[1]} has no column {m[2]}")
        return _replace(spark, m[1], table.drop(m[2]))
    if m := re.fullmatch(r"ALTER\s+TABLE\s+(\w+)\s+SET\s+TTL\s+(\d+)\s*(DAYS|HOURS)?", text, re.I):
        limit = int(m[2]) * HOUR_NS * (1 if (m[3] or "DAYS").upper() == "HOURS" else 24)
        spark.sql(f"ALTER TABLE {m[1]} SET TBLPROPERTIES ('ttl_ns' = '{limit}')")
        if "hour" in (c.name for c in spark.catalog.listColumns(m[1]) if c.isPartition):
            return _drop_hours(spark, m[1], limit, now_ns)
        return _replace(spark, m[1], unexpired(spark.table(m[1]), limit, now_ns))
    return spark.sql(text)


def unexpired(ticks: DataFrame, ttl_ns: int, now_ns: int | None = None, time: str = "timestamp") -> DataFrame:
    """Rows of hours that start within the limit; whole hours go at once."""
    now = F.lit(now_ns) if now_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    return ticks.where(F.call_function("div", F.col(time), F.lit(HOUR_NS)) * HOUR_NS >= now - ttl_ns)


def _drop_hours(spark: SparkSession, name: str, ttl_ns: int, now_ns: int | None) -> None:
    """Drops the partitions of hours that start before the limit."""
    least = (now_ns if now_ns is not None else time.time_ns()) - ttl_ns
    parts = [dict(p.split("=", 1) for p in r[0].split("/")) for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    old = [p for p in parts if p["hour"].lstrip("-").isdigit() and int(p["hour"]) < least]
    if old:
        spec = ", ".join("PARTITION (" + ", ".join(f"{k} = '{v}'" for k, v in p.items()) + ")" for p in old)
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {spec}")


def _replace(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Writes rows beside the table, then in its place: Parquet tables can't be changed where they lie.

    A break on the way leaves the old rows whole as name__old. Renaming doesn't take the folders of
    partitions along in every catalog, so a partitioned table is written once more under its name, and
    a break leaves the new rows whole as name__next.
    """
    beside, old, properties = f"{name}__next", f"{name}__old", {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect() if r.key == "ttl_ns"}
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    if lost := [c for c in parts if c not in rows.columns]:
        raise ValueError(f"{name} is partitioned by {lost[0]}")
    rows.write.mode("overwrite").format("parquet").saveAsTable(beside)
    if parts:
        spark.sql(f"DROP TABLE {name}")
        spark.table(beside).write.format("parquet").partitionBy(*parts).saveAsTable(name)
        spark.sql(f"DROP TABLE {beside}")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {old}")
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
        spark.sql(f"ALTER TABLE {beside} RENAME TO {name}")
        spark.sql(f"DROP TABLE {old}")
    for key, value in properties.items():
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{key}' = '{value}')")
