"""Tick storage: Parquet by symbol bucket and hour, its pruned reads, and columns from other frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.plans.ddl import HOUR_NS

CODECS = ("none", "snappy", "zstd", "lz4_raw")


def write_ticks(ticks: DataFrame, path: str, buckets: int = 64, compression: str = "zstd", mode: str = "append") -> None:
    """Partitions by hash of the symbol and by hour. Rebalancing splits a hot bucket's hour over files and joins small ones; rows within a file are sorted, so that its statistics prune."""
    if compression not in CODECS:
        raise ValueError(f"compression is one of {', '.join(CODECS)}")
    placed = ticks.withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")).withColumn("hour", F.call_function("div", F.col("timestamp"), F.lit(HOUR_NS)) * HOUR_NS)
    placed.hint("rebalance", "bucket", "hour").sortWithinPartitions("bucket", "hour", "symbol", "timestamp").write.mode(mode).option("compression", compression).partitionBy("bucket", "hour").parquet(path)


def read_ticks(spark: SparkSession, path: str, symbol: int | None = None, start: int | None = None, end: int | None = None, buckets: int = 64) -> DataFrame:
    """Rows of a symbol and time range; folders outside are not listed into the scan, the rest is pushed down to Parquet."""
    df = spark.read.parquet(path)
    if symbol is not None:
        df = df.where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(symbol).cast("long")), F.lit(buckets)).cast("int")) & (F.col("symbol") == symbol))
    if start is not None:
        df = df.where((F.col("hour") >= start // HOUR_NS * HOUR_NS) & (F.col("timestamp") >= start))
    if end is not None:
        df = df.where((F.col("hour") <= end) & (F.col("timestamp") <= end))
    return df.drop("bucket", "hour")


def from_columns(df: DataFrame, symbol: str = "sym", price: str = "price", volume: str = "volume", time: str | None = None, price_scale: float = 1.0) -> DataFrame:
    """Ticks from a frame of other names; prices are scaled and cut to whole numbers, nulls count as 0."""
    at = F.col(time).cast("long") if time else F.unix_micros(F.current_timestamp()) * 1000
    whole = lambda c, scale=1.0: F.coalesce((F.col(c) * scale).cast("long"), F.lit(0).cast("long"))
    return df.select(F.col(symbol).cast("long").alias("symbol"), at.alias("timestamp"), whole(price, price_scale).alias("price"), whole(volume).alias("volume"))


def seal(hot: DataFrame, path: str, before: int, buckets: int = 64, compression: str = "zstd") -> DataFrame:
    """Writes the hours of hot that end at or before the given time to storage; returns the rows that stay hot."""
    ends = F.call_function("div", F.col("timestamp"), F.lit(HOUR_NS)) * HOUR_NS + HOUR_NS
    write_ticks(hot.where(ends <= before), path, buckets, compression)
    return hot.where(ends > before)


def _hours(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Hours of tick storage and their folders: names alone are read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*/hour=*")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    return [(int(f.getPath().getName().removeprefix("hour=")), f.getPath().toString()) for f in found]


def expire(spark: SparkSession, path: str, ttl_ns: int, now_ns: int) -> int:
    """Drops the hours that start before the limit, folder by folder; returns how many went. No row is read or rewritten, and one run after another drops nothing twice."""
    old = [folder for hour, folder in _hours(spark, path) if hour < now_ns - ttl_ns]
    for folder in old:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(old)


def move_sealed(spark: SparkSession, hot: str, cold: str, before: int) -> int:
    """Moves the hours of hot storage that end at or before the given time to cold storage, file by file; returns how many. A run that broke off is gone on with by the next."""
    conf, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    ended = [folder for hour, folder in _hours(spark, hot) if hour + HOUR_NS <= before]
    for folder in ended:
        source = Path(folder)
        fs = source.getFileSystem(conf)
        target = Path(f"{cold}/{source.getParent().getName()}/{source.getName()}")
        fs.mkdirs(target)
        for f in fs.listStatus(source):
            if not fs.rename(f.getPath(), Path(target, f.getPath().getName())):
                raise OSError(f"{f.getPath().toString()} can't be moved")
        fs.delete(source, True)
    return len(ended)


class Retention:
    """What a running store does from time to time: seal hours by age, drop expired ones, take snapshots; recover() reads the latest on a start."""

    def __init__(self, spark: SparkSession, hot: str, cold: str, seal_after_ns: int, ttl_ns: int | None = None, snapshots: str | None = None):
        self.spark, self.hot, self.cold, self.seal_after_ns, self.ttl_ns, self.snapshots = spark, hot, cold, seal_after_ns, ttl_ns, snapshots

    def run(self, now_ns: int) -> dict[str, int]:
        done = {"sealed": move_sealed(self.spark, self.hot, self.cold, now_ns - self.seal_after_ns)}
        done["expired"] = sum(expire(self.spark, p, self.ttl_ns, now_ns) for p in (self.hot, self.cold)) if self.ttl_ns is not None else 0
        if self.snapshots and _hours(self.spark, self.hot):
            snapshot(read_ticks(self.spark, self.hot), f"{self.snapshots}/at={now_ns}")
        return done

    def recover(self) -> DataFrame | None:
        """Rows of the latest whole snapshot, if there is one."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.snapshots}/at=*/_SUCCESS")
        marks = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(root) or []
        folders = [m.getPath().getParent() for m in marks]
        return self.spark.read.parquet(max(folders, key=lambda f: int(f.getName().removeprefix("at="))).toString()) if folders else None


def key_path(template: str, table: str, hour_ns: int, bucket: str = "", **more: object) -> str:
    """A path by template, such as s3a://{bucket}/{table}/{date}/{hour}; an endpoint other than Amazon's is the session's spark.hadoop.fs.s3a.endpoint."""
    import datetime

    at = datetime.datetime.fromtimestamp(hour_ns // 1_000_000_000, datetime.timezone.utc)
    return template.format(table=table, date=f"{at:%Y-%m-%d}", hour=f"{at:%H}", bucket=bucket, **more)


def hot_and_cold(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Both as one table: filters and columns are pushed into each side."""
    return hot.unionByName(cold, allowMissingColumns=True)


def snapshot(df: DataFrame, path: str) -> None:
    """A copy that is whole or absent: it is complete once the writer's success mark is there."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def recover(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a snapshot; one without its success mark is refused."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        raise ValueError(f"{path} holds no complete snapshot")
    return spark.read.parquet(path)


def to_arrow(ticks: DataFrame, start: int | None = None, end: int | None = None, columns: tuple[str, ...] = ("price", "volume", "timestamp")):
    """Rows of [start, end] as an Arrow table, times as UTC timestamps in nanoseconds; for results that fit the driver."""
    import pyarrow as pa

    if start is not None:
        ticks = ticks.where(F.col("timestamp") >= start)
    if end is not None:
        ticks = ticks.where(F.col("timestamp") <= end)
    out = ticks.select(*columns).toArrow()
    if "timestamp" in columns:
        at = out.schema.get_field_index("timestamp")
        out = out.set_column(at, "timestamp", out.column(at).cast(pa.timestamp("ns", "UTC")))
    return out
