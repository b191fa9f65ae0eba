"""Rejected rows, kept with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import ERRORS, Validated

#: The columns of a rejected row.
COLUMNS = ["record", "error", "source", "timestamp"]
ADDED = "__weir_added"


class DeadLetters:
    """Rejected rows as record (JSON text), error, source and timestamp; of more than max_size, those added last are given out.

    With max_size None, all are. What add() is given together is in the order of timestamp and record."""

    def __init__(self, max_size: int | None = 10_000):
        if max_size is not None and max_size < 1:
            raise ValueError("max_size is at least 1")
        self.max_size = max_size
        self._frames: list[DataFrame] = []

    @staticmethod
    def letters(invalid: DataFrame, source: str, error: str = ERRORS) -> DataFrame:
        fields = [F.col(f"`{c}`") for c in invalid.columns if c != error]
        record = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        return invalid.select(record.alias("record"), F.col(error).alias("error"), F.lit(source).alias("source"), F.current_timestamp().alias("timestamp"))

    def add(self, rejected: DataFrame | Validated, source: str = "") -> None:
        frame = rejected.invalid if isinstance(rejected, Validated) else rejected
        self._frames.append(frame.select(*COLUMNS) if set(COLUMNS) <= set(frame.columns) else self.letters(frame, source))

    def _all(self) -> DataFrame | None:
        out = None
        for n, f in enumerate(self._frames):
            f = f.withColumn(ADDED, F.lit(n))
            out = f if out is None else out.unionByName(f)
        return out

    def get(self, source: str | None = None) -> DataFrame:
        """The letters, those added last first."""
        rows = self._all()
        if rows is None:
            raise LookupError("no letters yet")
        kept = rows.orderBy(F.desc(ADDED), F.desc("timestamp"), F.desc("record"))
        kept = (kept if self.max_size is None else kept.limit(self.max_size)).drop(ADDED)
        return kept if source is None else kept.filter(F.col("source") == source)

    def size(self) -> int:
        rows = self._all()
        n = 0 if rows is None else rows.count()
        return n if self.max_size is None else min(n, self.max_size)

    def flush(self) -> DataFrame:
        """The letters, which are then forgotten."""
        out = self.get()
        self._frames = []
        return out
