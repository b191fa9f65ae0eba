"""GET /health, /pipelines, /pipelines/{id} and /metrics, as JSON."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote, urlsplit

from .metrics import MetricsCollector


def answer(path: str, collector: MetricsCollector, store: Any = None) -> tuple[int, Any]:
    """Status and body. store: a RunStore to look in as well."""
    parts = [unquote(p) for p in urlsplit(path).path.split("/") if p]
    if parts == ["health"]:
        return 200, {"status": "healthy"}
    if parts == ["pipelines"]:
        runs = {r["run_id"]: r for r in [*(store.recent(100) if store else []), *collector.runs()]}
        return 200, sorted(runs.values(), key=lambda r: r.get("created_at") or "", reverse=True)
    if len(parts) == 2 and parts[0] == "pipelines":
        run = collector.get(parts[1]) or (store.get(parts[1]) if store else None)
        return (200, run) if run else (404, {"detail": f"no run {parts[1]!r}"})
    if parts == ["metrics"]:
        return 200, collector.totals()
    return 404, {"detail": "not found"}


def serve(host: str = "127.0.0.1", port: int = 8000, collector: MetricsCollector | None = None, store: Any = None) -> ThreadingHTTPServer:
    """A server, not yet running: call serve_forever()."""
    runs = collector or MetricsCollector.shared()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, body = answer(self.path, runs, store)
            text = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
