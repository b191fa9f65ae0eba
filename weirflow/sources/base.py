"""What sources and sinks have in common."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Source(Protocol):
    def read(self, spark: SparkSession) -> DataFrame: ...


class Sink(Protocol):
    def write(self, df: DataFrame) -> int: ...


class Counted:
    """Counts a frame's rows as they are written, without a job of its own."""

    def __init__(self, df: DataFrame):
        self._seen = Observation()
        self.df = df.observe(self._seen, F.count(F.lit(1)).alias("rows"))

    @property
    def rows(self) -> int:
        return int(self._seen.get["rows"])


#: How writers name what to do with what is there already.
MODES = {"w": "overwrite", "a": "append", "overwrite": "overwrite", "append": "append", "replace": "overwrite", "fail": "errorifexists"}


def mode_of(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
    return MODES[mode]
