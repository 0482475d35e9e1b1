"""A small HTTP server beside a running stream: probes, statistics, and a flush on demand."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery

from logloom.streaming import ingest

FLUSHED, NOT_FLUSHED = b"Flush completed successfully (offsets committed)", b"Flush failed"


def serve(query: StreamingQuery, stats: ingest.Stats, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """``GET /health``, ``/ready`` and ``/stats``, ``POST /flush``; a flush is answered when what it asks for is done."""

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
            if self.path == "/health":
                return self._answer(200, b"OK")
            if self.path == "/ready":
                return self._answer(200, b"OK") if ingest.health(query)["ready"] else self._answer(503, b"Stream is not running")
            if self.path == "/stats":
                stats.is_running = query.isActive
                return self._answer(200, stats.as_json().encode(), "application/json")
            return self._answer(404)

        def do_POST(self):
            if self.path != "/flush":
                return self._answer(404)
            try:
                if not query.isActive:
                    return self._answer(500, NOT_FLUSHED)
                ingest.flush(query)
            except StreamingQueryException:
                return self._answer(500, NOT_FLUSHED)
            return self._answer(200, FLUSHED)

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
