"""The protocol of operators that are objects."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Transform(Protocol):
    """Anything that turns a frame into a frame, lazily; a plain function will do as well."""

    def __call__(self, df: DataFrame) -> DataFrame: ...
