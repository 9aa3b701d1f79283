"""Jobs by interval, once at a time, or daily, on a driver's threads; a job's error is kept and ends nothing."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone


class Scheduler:
    def __init__(self) -> None:
        self._stops: dict[str, threading.Event] = {}
        self.runs: dict[str, int] = {}
        self.errors: dict[str, Exception] = {}

    def _start(self, job: Callable[[], object], wait: Callable[[], float | None]) -> str:
        number, stop = uuid.uuid4().hex, threading.Event()
        self._stops[number], self.runs[number] = stop, 0

        def loop() -> None:
            while (seconds := wait()) is not None and not stop.wait(seconds):
                try:
                    job()
                except Exception as e:
                    self.errors[number] = e
                self.runs[number] += 1
            stop.set()

        threading.Thread(target=loop, daemon=True).start()
        return number

    def every(self, seconds: float, job: Callable[[], object]) -> str:
        """Runs after each pause; a job never overlaps itself."""
        return self._start(job, lambda: seconds)

    def once(self, at: datetime, job: Callable[[], object]) -> str:
        waits = [max(0.0, (at - datetime.now(timezone.utc)).total_seconds())]
        return self._start(job, lambda: waits.pop() if waits else None)

    def daily(self, hour: int, minute: int, job: Callable[[], object]) -> str:
        return self._start(job, lambda: until(hour, minute, datetime.now(timezone.utc)))

    def cancel(self, number: str) -> bool:
        stop = self._stops.get(number)
        if stop is None or stop.is_set():
            return False
        stop.set()
        return True

    def active(self) -> list[str]:
        return sorted(k for k, stop in self._stops.items() if not stop.is_set())

    def shutdown(self) -> None:
        for number in self.active():
            self.cancel(number)


def until(hour: int, minute: int, now: datetime) -> float:
    """Seconds to the next time of day in UTC, which is never now."""
    then = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    return ((then if then > now else then + timedelta(days=1)) - now).total_seconds()
