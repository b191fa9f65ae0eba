"""Runs that this process has seen."""

from __future__ import annotations

import threading
from typing import Any


class MetricsCollector:
    """Runs by id; safe among threads. shared() is the process's own."""

    _shared: MetricsCollector | None = None
    _guard = threading.Lock()

    def __init__(self):
        self._runs: dict[str, dict[str, Any]] = {}
        self._lock = threading.Lock()

    @classmethod
    def shared(cls) -> MetricsCollector:
        with cls._guard:
            cls._shared = cls._shared or cls()
            return cls._shared

    def record(self, run: dict[str, Any]) -> None:
        with self._lock:
            self._runs[run["run_id"]] = run

    def get(self, run_id: str) -> dict[str, Any] | None:
        with self._lock:
            return self._runs.get(run_id)

    def runs(self) -> list[dict[str, Any]]:
        """The newest first."""
        with self._lock:
            return sorted(self._runs.values(), key=lambda r: r.get("created_at") or "", reverse=True)

    def totals(self) -> dict[str, Any]:
        runs = self.runs()
        n = len(runs)
        good, bad = (sum(r["status"] == s for r in runs) for s in ("completed", "failed"))
        times = [r["duration"] for r in runs if r.get("duration") is not None]
        records = sum(s.get("output_records") or 0 for r in runs for s in r.get("nodes", {}).values())
        return {"total_runs": n, "successful_runs": good, "failed_runs": bad, "success_rate": good / n if n else 0.0, "failure_rate": bad / n if n else 0.0, "avg_duration": round(sum(times) / len(times), 3) if times else 0.0, "total_records": records}

    def reset(self) -> None:
        with self._lock:
            self._runs.clear()
