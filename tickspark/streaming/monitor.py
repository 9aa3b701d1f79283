"""Progress of streams as Prometheus text."""

from __future__ import annotations

import threading

from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


class Progress(StreamingQueryListener):
    """Add it with spark.streams.addListener; counters are per query name, or id where it has none."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.rate: dict[str, float] = {}
        self.failed = 0
        self._lock = threading.Lock()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        with self._lock:
            self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        name = p.name or str(p.id)
        with self._lock:
            self.rows[name] = self.rows.get(name, 0) + p.numInputRows
            self.batches[name] = self.batches.get(name, 0) + 1
            self.rate[name] = p.processedRowsPerSecond

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        with self._lock:
            self.failed += event.exception is not None

    def text(self) -> str:
        kinds = (("tickspark_rows_total", "counter", self.rows), ("tickspark_batches_total", "counter", self.batches), ("tickspark_rows_per_second", "gauge", self.rate))
        with self._lock:
            lines = [line for name, kind, values in kinds for line in (f"# TYPE {name} {kind}", *(f'{name}{{query="{q}"}} {v:g}' for q, v in sorted(values.items())))]
            return "\n".join([*lines, "# TYPE tickspark_failed_total counter", f"tickspark_failed_total {self.failed}", ""])
