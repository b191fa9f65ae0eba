"""Small batches, by count or time."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.plans.ordering import PART, ROW, in_ranges, row_numbers

from .windows import seconds


def in_batches(df: DataFrame, size: int, order_by: list[str], name: str = "batch") -> DataFrame:
    """df with the number of each row's batch of so many rows in an order."""
    if size < 1:
        raise ValueError("size is at least 1")
    ranged = in_ranges(df, order_by, "batches")
    return ranged.withColumn(name, F.floor(row_numbers(ranged) / size).cast("long")).drop(PART, ROW)


@dataclass
class BatchWindow:
    """Records that a driver gathers until there are max_size of them, or until max_wait has passed since the first.

    For streams, trigger() and limits() say the same to Spark.
    """

    max_size: int = 100
    max_wait: str | float = 10
    clock: Callable[[], float] = time.monotonic
    _held: list[Any] = field(default_factory=list)
    _since: float = 0.0

    def __post_init__(self):
        if self.max_size < 1 or seconds(self.max_wait) <= 0:
            raise ValueError("max_size and max_wait are over 0")

    def add(self, record: Any) -> list[Any] | None:
        """The batch, if this record completes it."""
        if not self._held:
            self._since = self.clock()
        self._held.append(record)
        return self.flush() if len(self._held) >= self.max_size or self.clock() - self._since >= seconds(self.max_wait) else None

    def flush(self) -> list[Any]:
        out, self._held = self._held, []
        return out

    def __len__(self) -> int:
        return len(self._held)

    def trigger(self) -> dict[str, str]:
        return {"processingTime": f"{seconds(self.max_wait):g} seconds"}

    def limits(self) -> dict[str, str]:
        """Options of a Kafka source."""
        return {"maxOffsetsPerTrigger": str(self.max_size)}
