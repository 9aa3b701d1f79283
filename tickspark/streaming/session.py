"""Batches of ticks into storage one by one, with counts and a policy for batches that fail; and the Kafka source."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickspark.sources.store import from_columns, write_ticks


@dataclass
class IngestSession:
    """on_error: raise, skip or warn. A batch is written whole or counts as failed; progress hears of each."""

    path: str
    on_error: str = "raise"
    buckets: int = 64
    columns: dict[str, object] = field(default_factory=dict)
    progress: Callable[[int, int], None] | None = None
    rows: int = 0
    batches: int = 0
    failed: int = 0

    def __post_init__(self) -> None:
        if self.on_error not in ("raise", "skip", "warn"):
            raise ValueError("on_error is raise, skip or warn")

    def add(self, batch: DataFrame) -> bool:
        try:
            counted = Observation()
            write_ticks(from_columns(batch, **self.columns).observe(counted, F.count("*").alias("n")), self.path, self.buckets)  # type: ignore[arg-type]
        except Exception as e:
            self.failed += 1
            if self.on_error == "raise":
                raise
            if self.on_error == "warn":
                warnings.warn(f"a batch was left out: {str(e).splitlines()[0]}", stacklevel=2)
            return False
        self.rows += counted.get["n"]
        self.batches += 1
        if self.progress:
            self.progress(self.batches, self.rows)
        return True

    def add_all(self, batches: Iterable[DataFrame]) -> IngestSession:
        for batch in batches:
            self.add(batch)
        return self


def kafka_messages(spark: SparkSession, servers: str, topic: str, start: str = "latest", per_batch: int | None = None) -> DataFrame:
    """A topic's values as a stream; offsets are the checkpoint's, so a message is processed once. Needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start)
    if per_batch:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return reader.load().select("value", "timestamp")
