"""How far a run is."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from enum import Enum
from typing import Any


class Status(Enum):
    PENDING = "pending"
    RUNNING = "running"
    COMPLETED = "completed"
    FAILED = "failed"
    CANCELLED = "cancelled"

    @property
    def over(self) -> bool:
        return self in (Status.COMPLETED, Status.FAILED, Status.CANCELLED)


def _now() -> datetime:
    return datetime.now(UTC)


@dataclass
class StepState:
    id: str
    status: Status = Status.PENDING
    started: datetime | None = None
    ended: datetime | None = None
    error: str | None = None
    attempts: int = 0
    input_records: int | None = None
    output_records: int | None = None

    @property
    def duration(self) -> float | None:
        return ((self.ended or _now()) - self.started).total_seconds() if self.started else None

    def to_dict(self) -> dict[str, Any]:
        return {"id": self.id, "status": self.status.value, "started_at": self.started and self.started.isoformat(), "completed_at": self.ended and self.ended.isoformat(), "duration": self.duration, "error": self.error, "attempts": self.attempts, "input_records": self.input_records, "output_records": self.output_records}


@dataclass
class RunState:
    """A run and its steps; safe among threads."""

    pipeline: str
    steps: dict[str, StepState]
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: Status = Status.PENDING
    created: datetime = field(default_factory=_now)
    started: datetime | None = None
    ended: datetime | None = None
    error: str | None = None

    def __post_init__(self):
        self._lock = threading.RLock()

    @property
    def duration(self) -> float | None:
        return ((self.ended or _now()) - self.started).total_seconds() if self.started else None

    def start(self) -> None:
        with self._lock:
            self._expect(self.status, Status.PENDING)
            self.status, self.started = Status.RUNNING, _now()

    def finish(self, status: Status, error: str | None = None) -> None:
        with self._lock:
            if not self.status.over:
                self.status, self.ended, self.error = status, _now(), error

    def cancel(self) -> None:
        """Steps that aren't over are cancelled, and none is ready any more."""
        with self._lock:
            for s in self.steps.values():
                if not s.status.over:
                    s.status, s.ended = Status.CANCELLED, _now()
            self.finish(Status.CANCELLED)

    def step_started(self, step: str) -> None:
        with self._lock:
            s = self.steps[step]
            self._expect(s.status, Status.PENDING)
            s.status, s.started = Status.RUNNING, _now()

    def step_tried(self, step: str) -> None:
        with self._lock:
            self.steps[step].attempts += 1

    def step_done(self, step: str, output_records: int | None = None) -> None:
        with self._lock:
            s = self.steps[step]
            if s.status is Status.RUNNING:
                s.status, s.ended, s.output_records = Status.COMPLETED, _now(), output_records

    def step_failed(self, step: str, error: str) -> None:
        with self._lock:
            s = self.steps[step]
            if not s.status.over:
                s.status, s.ended, s.error = Status.FAILED, _now(), error

    def ready(self, dependencies: dict[str, list[str]]) -> list[str]:
        """Steps that wait for nothing more, by name."""
        with self._lock:
            if self.status.over:
                return []
            return sorted(s for s, x in self.steps.items() if x.status is Status.PENDING and all(self.steps[d].status is Status.COMPLETED for d in dependencies.get(s, [])))

    def failed(self) -> bool:
        with self._lock:
            return any(s.status is Status.FAILED for s in self.steps.values())

    def summary(self) -> dict[str, int]:
        """Steps by status."""
        with self._lock:
            return {k.value: sum(s.status is k for s in self.steps.values()) for k in Status}

    def to_dict(self) -> dict[str, Any]:
        with self._lock:
            return {"run_id": self.run_id, "pipeline": self.pipeline, "status": self.status.value, "created_at": self.created.isoformat(), "started_at": self.started and self.started.isoformat(), "completed_at": self.ended and self.ended.isoformat(), "duration": self.duration, "error": self.error, "summary": self.summary(), "nodes": {k: s.to_dict() for k, s in self.steps.items()}}

    @staticmethod
    def _expect(have: Status, *wanted: Status) -> None:
        if have not in wanted:
            raise ValueError(f"{have.value} can't go on from here")
