"""Splayed, date-partitioned column folders: root/sym, root/YYYY.MM.DD/table/column.

A column file has eight bytes of header (byte order, type, six unused) and then its values. Listing and
reading go through Spark's binary file source, so any store that Spark reads will do; a task decodes
the columns of one table folder, which is one date.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type number to the layout of a value in the file and its type in Spark. Times stay in the units of the file.
TYPES = {
    1: ("i1", "boolean"),
    4: ("u1", "short"),
    5: ("i2", "short"),
    6: ("i4", "int"),
    7: ("i8", "long"),
    8: ("f4", "float"),
    9: ("f8", "double"),
    10: ("S1", "string"),
    11: ("i4", "string"),
    12: ("i8", "long"),
    13: ("i4", "int"),
    14: ("i4", "int"),
    15: ("f8", "double"),
    16: ("i8", "long"),
    17: ("i4", "int"),
    18: ("i4", "int"),
    19: ("i4", "int"),
}
HEADER, SYMBOL = 8, 11


def _header(content: bytes) -> tuple[str, str, int]:
    """Layout, Spark type and type number of a column file."""
    if len(content) < HEADER or content[1] not in TYPES:
        raise ValueError(f"no column of a known type: {content[:HEADER].hex()}")
    layout, kind = TYPES[content[1]]
    return ("<" if content[0] == 1 else ">") + layout, kind, content[1]


def decode(content: bytes, symbols: list[str]) -> pa.Array:
    """The values of a column file; symbols are their names, null beyond the list."""
    layout, kind, number = _header(content)
    step = np.dtype(layout).itemsize
    values = np.frombuffer(content, layout, (len(content) - HEADER) // step, HEADER)
    if number == SYMBOL:
        known = (values >= 0) & (values < len(symbols))
        return pa.array(symbols, pa.string()).take(pa.array(np.where(known, values, 0), mask=~known)) if symbols else pa.nulls(len(values), pa.string())
    if kind == "string":
        return pa.array([x.decode("latin-1") for x in values.tolist()], pa.string())
    return pa.array(values.astype(bool) if kind == "boolean" else values.astype(values.dtype.newbyteorder("=")).astype(np.int16 if kind == "short" else values.dtype.newbyteorder("=")))


def symbol_names(spark: SparkSession, root: str) -> list[str]:
    """Names of root/sym, each ended by a zero byte. It lists the distinct symbols of the store, not rows."""
    rows = spark.read.format("binaryFile").load(f"{root}/sym").select("content").collect()
    return [x.decode() for x in bytes(rows[0][0]).split(b"\0") if x] if rows else []


def tables(spark: SparkSession, root: str) -> DataFrame:
    """table, date and column files of a store, without their contents."""
    files = spark.read.format("binaryFile").load(f"{root}/*.*.*/*/*").select("path", "length")
    part = lambda i: F.element_at(F.split("path", "/"), -i)
    return files.select(part(2).alias("table"), part(3).alias("date"), part(1).alias("column"), "length").where("column not like '.%' and date rlike '^[0-9]{4}[.][0-9]{2}[.][0-9]{2}$'")


def read_splayed(spark: SparkSession, root: str, table: str, dates: str = "*.*.*", has_symbols: bool = True) -> DataFrame:
    """Rows of a table with their date. dates: a glob over date folders, so that others aren't listed.

    Columns and types are those of the first date; a later date without one gets nulls, and columns
    of one date must be of equal length. Row order within a date is kept in `row`.
    """
    files = spark.read.format("binaryFile").load(f"{root}/{dates}/{table}/*").withColumn("column", F.element_at(F.split("path", "/"), -1)).withColumn("date", F.element_at(F.split("path", "/"), -3)).where("column not like '.%'")
    first = files.agg(F.min("date")).first()[0]
    if first is None:
        raise ValueError(f"no table {table} under {root}")
    kinds = [(r["column"], _header(bytes(r["head"]))[1]) for r in files.where(F.col("date") == first).select("column", F.substring("content", 1, HEADER).alias("head")).orderBy("column").collect()]
    symbols = symbol_names(spark, root) if has_symbols else []
    schema = ", ".join(["date string", "row long", *(f"`{c}` {kind}" for c, kind in kinds)])
    types = pa.schema([("date", pa.string()), ("row", pa.int64()), *((c, {"boolean": pa.bool_(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string()}[kind]) for c, kind in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for date, contents in zip(b.column("date").to_pylist(), b.column("files").to_pylist(), strict=True):
                columns = {f["column"]: decode(f["content"], symbols) for f in contents}
                n = max(map(len, columns.values()))
                if any(len(x) != n for x in columns.values()):
                    raise ValueError(f"columns of {date} differ in length")
                arrays = [columns[c].cast(types.field(c).type) if c in columns else pa.nulls(n, types.field(c).type) for c, _ in kinds]
                yield from pa.Table.from_arrays([pa.array([date] * n, pa.string()), pa.array(np.arange(n)), *arrays], schema=types).to_batches(50_000)

    by_date = files.groupBy("date").agg(F.collect_list(F.struct("column", "content")).alias("files"))
    return by_date.mapInArrow(run, schema)
