"""Unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, by column name; a column that a frame lacks is NULL there."""
    if not frames:
        raise ValueError("no frames given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
