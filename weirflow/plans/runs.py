"""Runs on record, in a SQLite file of the driver's."""

from __future__ import annotations

import json
import sqlite3
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a run on record.
SCHEMA = "run_id string, pipeline_name string, status string, started_at string, completed_at string, duration double, error string, created_at string, detail string"


@dataclass
class RunStore:
    """Runs by id; saving one again replaces it."""

    path: str = "weirflow_runs.db"
    _memory: sqlite3.Connection | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.path == ":memory:":
            self._memory = sqlite3.connect(self.path, check_same_thread=False)
        with self._db() as db:
            db.execute("CREATE TABLE IF NOT EXISTS runs (run_id TEXT PRIMARY KEY, pipeline_name TEXT NOT NULL, status TEXT NOT NULL, started_at TEXT, completed_at TEXT, duration REAL, error TEXT, created_at TEXT NOT NULL, detail TEXT)")
            db.execute("CREATE INDEX IF NOT EXISTS runs_by_name ON runs (pipeline_name, created_at)")

    def _db(self) -> sqlite3.Connection:
        return self._memory or sqlite3.connect(self.path)

    def save(self, run: dict[str, Any]) -> None:
        """run: what RunState.to_dict() gives."""
        row = (run["run_id"], run["pipeline"], run["status"], run.get("started_at"), run.get("completed_at"), run.get("duration"), run.get("error"), run.get("created_at") or datetime.now(UTC).isoformat(), json.dumps(run, default=str))
        with self._db() as db:
            db.execute("INSERT INTO runs VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?) ON CONFLICT (run_id) DO UPDATE SET status = excluded.status, started_at = excluded.started_at, completed_at = excluded.completed_at, duration = excluded.duration, error = excluded.error, detail = excluded.detail", row)

    def get(self, run_id: str) -> dict[str, Any] | None:
        with self._db() as db:
            found = db.execute("SELECT detail FROM runs WHERE run_id = ?", (run_id,)).fetchone()
        return json.loads(found[0]) if found else None

    def recent(self, limit: int = 10, pipeline: str | None = None) -> list[dict[str, Any]]:
        """The newest runs, the newest first."""
        where, params = ("WHERE pipeline_name = ?", [pipeline]) if pipeline else ("", [])
        with self._db() as db:
            rows = db.execute(f"SELECT detail FROM runs {where} ORDER BY created_at DESC, run_id LIMIT ?", [*params, limit]).fetchall()
        return [json.loads(r[0]) for r in rows]

    def frame(self, spark: SparkSession) -> DataFrame:
        with self._db() as db:
            rows = db.execute("SELECT * FROM runs").fetchall()
        return spark.createDataFrame(rows, SCHEMA)


def run_metrics(runs: DataFrame, status: str = "status", duration: str = "duration", records: str | None = None) -> DataFrame:
    """Totals over runs: counts and rates of those completed and failed, and the mean duration to three places."""
    done, bad = F.col(status) == "completed", F.col(status) == "failed"
    made = [
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(done).alias("successful_runs"),
        F.count_if(bad).alias("failed_runs"),
        F.coalesce(F.avg(done.cast("int")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(bad.cast("int")), F.lit(0.0)).alias("failure_rate"),
        F.round(F.coalesce(F.avg(duration), F.lit(0.0)), 3).alias("avg_duration"),
    ]
    return runs.agg(*made, *([F.coalesce(F.sum(records), F.lit(0)).alias("total_records")] if records else []))
