"""An HTTP front: POST / takes SQL and answers {columns, data, rows, execution_time_us}; GET /ping, /health, /stats; DELETE /ID ends a query.

Each query runs under a job group, by which a timeout or DELETE ends its jobs. It listens on this
machine alone unless told otherwise; with tokens, a request must carry one of them as its bearer.
All rows go over the wire, by way of a temporary file, unless a `limit` is set; then a cut answer says
"truncated": true. SQL may read whatever the session may: what users may see is the
catalog's to decide.
"""

from __future__ import annotations

import hmac
import io
import json
import shutil
import tempfile
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from tickspark.cli import pieces
from tickspark.plans import dialect

#: Longest statement that is read.
MOST_BYTES = 1 << 20
#: Bytes of an answer that stay in memory.
IN_MEMORY = 1 << 24


class Front:
    def __init__(self, spark: SparkSession, tokens: tuple[str, ...] = (), limit: int | None = None, timeout: float = 60.0):
        self.spark, self.tokens, self.limit, self.timeout = spark, tokens, limit, timeout
        self.running: dict[str, float] = {}
        self.ended: set[str] = set()
        self.counts = {"queries": 0, "failed": 0, "timeouts": 0}
        self._lock = threading.Lock()

    def admits(self, header: str | None) -> bool:
        given = (header or "").removeprefix("Bearer ").encode()
        return not self.tokens or any([hmac.compare_digest(given, t.encode()) for t in self.tokens])

    def cancel(self, number: str) -> bool:
        known = number in self.running
        if known:
            self.ended.add(number)
            self.spark.sparkContext.cancelJobGroup(number)
        return known

    def query(self, sql: str) -> tuple[int, dict | IO[bytes]]:
        """The status, and an error or the file of the answer."""
        number, start, found = uuid.uuid4().hex, time.perf_counter(), {}
        with self._lock:
            self.running[number] = time.time()
            self.counts["queries"] += 1

        def work() -> None:
            try:
                self.spark.sparkContext.setJobGroup(number, sql[:200], interruptOnCancel=True)
                body, last = tempfile.SpooledTemporaryFile(IN_MEMORY), ""
                for piece in pieces(dialect.sql(self.spark, sql.strip().rstrip(";")), "json", self.limit):
                    # a partition's job may end between two cancellations
                    if number in self.ended:
                        raise RuntimeError("the query was ended")
                    body.write(last.encode())
                    last = piece
                # the closing brace waits for the time
                body.write(f'{last[:-1]}, "execution_time_us": {round((time.perf_counter() - start) * 1e6, 2)}}}'.encode())
                found["body"] = body
            except Exception as e:
                found["error"] = (str(e).splitlines() or [type(e).__name__])[0]
            finally:
                self.ended.discard(number)

        thread = InheritableThread(target=work, daemon=True)
        thread.start()
        thread.join(self.timeout)
        late = thread.is_alive()
        if late:
            self.cancel(number)
        with self._lock:
            self.running.pop(number, None)
            if not late:
                self.ended.discard(number)
            self.counts["timeouts"] += late
            self.counts["failed"] += not late and "error" in found
        if late:
            return 408, {"error": f"no answer within {self.timeout:g} s"}
        if "error" in found:
            return 400, {"error": found["error"]}
        return 200, found["body"]

    def state(self) -> dict:
        with self._lock:
            return self.counts | {"running": sorted(self.running)}


def _handler(front: Front) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict | IO[bytes]) -> None:
            if isinstance(body, dict):
                body = io.BytesIO(json.dumps(body).encode())
            with body:
                length = body.seek(0, io.SEEK_END)
                body.seek(0)
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(length))
                self.end_headers()
                shutil.copyfileobj(body, self.wfile)

        def admitted(self) -> bool:
            if not front.admits(self.headers.get("Authorization")):
                self.answer(401, {"error": "a bearer token is needed"})
                return False
            return True

        def do_GET(self) -> None:
            if self.path in ("/ping", "/health"):
                self.answer(200, {"status": "ok"})
            elif self.admitted():
                self.answer(*((200, front.state()) if self.path == "/stats" else (404, {"error": "no such page"})))

        def do_DELETE(self) -> None:
            if self.admitted():
                self.answer(*((200, {"status": "cancelled"}) if front.cancel(self.path[1:]) else (404, {"error": "no such query"})))

        def do_POST(self) -> None:
            if not self.admitted():
                return
            length = self.headers.get("Content-Length", "")
            if not length.isdigit() or int(length) > MOST_BYTES:
                self.answer(413 if length.isdigit() else 411, {"error": f"SQL of at most {MOST_BYTES} bytes with its length is needed"})
            else:
                self.answer(*front.query(self.rfile.read(int(length)).decode("utf-8", "replace")))

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(front: Front, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that runs in a thread until its shutdown(); server_address says where."""
    server = ThreadingHTTPServer((host, port), _handler(front))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
