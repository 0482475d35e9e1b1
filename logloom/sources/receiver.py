"""A small HTTP receiver that lands envelopes as files for the queue.

Each request that is accepted is one file, written under another name and renamed, so a
stream that reads the folder sees it whole or not at all.  The answer follows the rename.
"""

from __future__ import annotations

import os
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
import pyarrow.parquet as pq

from logloom.functions import otlp
from logloom.schema import JSON_TYPES, OTEL_LOGS, PROTOBUF_TYPES, TOPIC
from logloom.sources.requests import BAD_GZIP, PATH

_QUEUE = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("value", pa.binary())])


class Landing:
    """Appends envelopes to a folder; offsets count up within each partition."""

    def __init__(self, folder: str, topic: str = TOPIC, partitions: int = 3):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.topic = folder, topic
        self.next = [0] * partitions
        for name in os.listdir(folder):
            if name.endswith(".parquet"):
                partition, offset = map(int, name.split("-")[:2])
                self.next[partition] = max(self.next[partition], offset + 1)
        self.turn, self.lock = 0, threading.Lock()

    def ready(self) -> bool:
        """Whether the folder takes files now."""
        return os.path.isdir(self.folder) and os.access(self.folder, os.W_OK | os.X_OK)

    def append(self, value: bytes) -> None:
        with self.lock:
            partition = self.turn = (self.turn + 1) % len(self.next)
            offset = self.next[partition]
            self.next[partition] += 1
        name = f"{partition}-{offset:012d}-{uuid.uuid4().hex}"
        draft = os.path.join(self.folder, f".{name}")
        pq.write_table(pa.table([[self.topic], [partition], [offset], [value]], schema=_QUEUE), draft)
        os.rename(draft, os.path.join(self.folder, f"{name}.parquet"))


def serve(landing: Landing | None, host: str = "127.0.0.1", port: int = 4318, max_in_flight: int = 1000, most_bytes: int = 64 << 20) -> ThreadingHTTPServer:
    """Starts the receiver in a thread of its own; without ``landing`` requests are accepted and only counted.

    A body of more than ``most_bytes`` is answered with 413 and not read.
    """
    in_flight = threading.BoundedSemaphore(max_in_flight)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _answer(self, status: int, body: bytes = b"", kind: str = "text/plain") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            if self.path == "/ready" and landing and not landing.ready():
                return self._answer(503, b"Queue producer not ready")
            self._answer(200, b"OK") if self.path in ("/health", "/ready") else self._answer(404)

        def do_POST(self):
            length = self.headers.get("Content-Length") or "0"
            if not length.isascii() or not length.isdigit() or int(length) > most_bytes:
                self.close_connection = True
                return self._answer(413 if length.isdigit() else 400)
            body = self.rfile.read(int(length))
            if self.path != PATH:
                return self._answer(404)
            kind = (self.headers.get("Content-Type") or "").partition(";")[0].strip(" ").lower()
            if kind not in JSON_TYPES + PROTOBUF_TYPES:
                return self._answer(415, b"Unsupported media type")
            if (self.headers.get("Content-Encoding") or "").strip(" ").lower() == "gzip":
                body = otlp.gunzip(body)
                if body is None:
                    return self._answer(400, BAD_GZIP.encode())
            if not in_flight.acquire(blocking=False):
                return self._answer(429)
            try:
                if landing:
                    wrapped = otlp.messages()["RawTelemetryMessage"](content_type=kind, telemetry_type=OTEL_LOGS, payload=body)
                    landing.append(wrapped.SerializeToString())
            except OSError:
                return self._answer(503)
            finally:
                in_flight.release()
            return self._answer(200, b"", "application/x-protobuf")

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
