"""Streams run batch by batch: transform, validate, set apart, write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weirflow.validation import DeadLetters, Validated

Step = Callable[[DataFrame], DataFrame]


@dataclass
class StreamMetrics:
    """Rows so far. A batch that runs again after a failure is counted once."""

    read: int = 0
    written: int = 0
    failed: int = 0
    batches: int = 0
    last_batch: int = -1

    def to_dict(self) -> dict[str, int]:
        return {"records_read": self.read, "records_written": self.written, "records_failed": self.failed, "batches_processed": self.batches}


@dataclass
class StreamRunner:
    """Takes a streaming frame through steps into a sink.

    Steps before the sink are part of the streaming plan, so that their state goes on from batch to batch. validate gets a batch
    and gives a Validated; invalid rows go to dead_letter, as letters. sink gets each batch's frame and its number, which it can use
    to write a batch once only.
    """

    source: DataFrame
    sink: Callable[[DataFrame, int], object]
    transforms: list[Step] = field(default_factory=list)
    validate: Callable[[DataFrame], Validated] | None = None
    dead_letter: Callable[[DataFrame, int], object] | None = None
    name: str = "stream"
    metrics: StreamMetrics = field(default_factory=StreamMetrics)

    def plan(self) -> DataFrame:
        out = self.source
        for step in self.transforms:
            out = step(out)
        return out

    def _batch(self, df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            good, bad = df, None
            if self.validate:
                done = self.validate(df)
                good, bad = done.valid, done.invalid
            self.sink(good, number)
            total = df.count()
            failed = bad.count() if bad is not None else 0
            if bad is not None and failed and self.dead_letter:
                self.dead_letter(DeadLetters.letters(bad, self.name), number)
        finally:
            df.unpersist()
        m = self.metrics
        if number > m.last_batch:
            m.read, m.failed, m.written, m.batches, m.last_batch = m.read + total, m.failed + failed, m.written + total - failed, m.batches + 1, number

    def start(self, checkpoint: str, output_mode: str = "append", **trigger):
        """The running query. trigger: availableNow=True for what is there, or processingTime="10 seconds"."""
        writer = self.plan().writeStream.foreachBatch(self._batch).outputMode(output_mode).queryName(self.name).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def run(self, checkpoint: str, output_mode: str = "append") -> StreamMetrics:
        """Works off what is there, and ends."""
        self.start(checkpoint, output_mode, availableNow=True).awaitTermination()
        return self.metrics


def route(df: DataFrame, routes: dict[str, tuple[str, Callable[[DataFrame], object]]]) -> None:
    """Writes the rows of a batch that pass a sink condition to that sink, for each route (condition, writer)."""
    from weirflow.functions import sink_column

    for condition, writer in routes.values():
        writer(df.filter(sink_column(condition, df)))
