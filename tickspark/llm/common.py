"""Helpers that the operators of this subpackage share: work folders, written steps, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the operators' contracts name it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that join_split() may broadcast.
MOST = 1000
#: Folders made by work_dir(), for cleanup().
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster gets an error,
    because a folder of one machine can't be read by the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tickspark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; it stays until cleanup()."""
    path = f"{shared_dir(spark)}/tickspark-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes the work folders of this process; call it once results have been consumed."""
    while _made:
        remove(spark, _made.pop())


def written(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Writes df as Parquet and reads it back: lineage ends there, and lost executors repeat nothing before it."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def trim() -> None:
    """Gives freed memory of this process back to the system, where its C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def join_split(rows: DataFrame, facts: DataFrame, key: str, uses: str, total: int) -> DataFrame:
    """rows joined by key with facts, which has one row a key; facts.uses says how many of rows have it.

    Keys with more than one in MOST of the total rows are at most MOST keys, whatever the size: their
    facts are broadcast, and their rows stay where they are. All others are dealt by key.
    """
    hot = F.broadcast(facts.where(F.col(uses) > total // MOST))  # at most MOST rows
    stay = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(stay.join(facts.where(F.col(uses) <= total // MOST), key))


def in_blocks(batches: Iterator[pa.RecordBatch], text: str, chars: int = 6_000_000, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a block's texts stay near the given bytes, and at most the given rows; a longer text is a block of its own.

    The cycle collector rests meanwhile: blocks make many small lists and no cycles.
    """
    collecting = gc.isenabled()
    gc.disable()
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
            start, held = 0, 0
            for i, n in enumerate(sizes):
                if held and held + n > chars or i - start >= rows:
                    yield batch.slice(start, i - start)
                    pa.default_memory_pool().release_unused()
                    start, held = i, 0
                held += n
            if start < len(sizes):
                yield batch.slice(start)
            pa.default_memory_pool().release_unused()
    finally:
        trim()
        if collecting:
            gc.enable()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def is_held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2: rows that no model learns from. A null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2
