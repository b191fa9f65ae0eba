"""Aggregate specs such as sum(amount), in a batch and a streaming dialect.

In the batch dialect, count() counts rows whatever its argument, the other functions skip NULL, and first and last take the
first and last value that isn't NULL by a given order. In the streaming dialect, sum and avg take a missing value as 0.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .columns import column, is_number

AGGREGATES = ("sum", "avg", "min", "max", "count", "first", "last")
STREAM_AGGREGATES = ("sum", "avg", "min", "max", "count")
_SPEC = re.compile(r"\s*(\w+)\s*(?:\(\s*([\w.]*|\*)\s*\))?\s*")


class Aggregate(NamedTuple):
    output: str
    function: str
    column: str


def parse_aggregate(output: str, spec: str, functions: tuple[str, ...] = AGGREGATES) -> Aggregate:
    """Only count may go without a column, or with *."""
    m = _SPEC.fullmatch(spec)
    if not m or m[1].lower() not in functions:
        raise ValueError(f"not an aggregate: {spec!r}; functions are {', '.join(functions)}")
    function, name = m[1].lower(), m[2] or ""
    if function == "count":
        return Aggregate(output, function, "" if name == "*" else name)
    if name in ("", "*"):
        raise ValueError(f"{function} needs a column: {spec!r}")
    return Aggregate(output, function, name)


def parse_aggregates(specs: dict[str, str], functions: tuple[str, ...] = AGGREGATES) -> list[Aggregate]:
    if not specs:
        raise ValueError("no aggregates given")
    return [parse_aggregate(k, v, functions) for k, v in specs.items()]


def aggregate_column(agg: Aggregate, schema: DataFrame | StructType, order: Column | None = None, missing_is_zero: bool = False) -> Column:
    """The aggregate as a column. first and last need an order; equal places give any of their values."""
    if agg.function == "count":
        return F.count(F.lit(1)).alias(agg.output)
    value, kind = column(schema, agg.column)
    if missing_is_zero and agg.function in ("sum", "avg"):
        value = F.coalesce(value if is_number(kind) else value.cast("double"), F.lit(0))
    if agg.function in ("first", "last"):
        if order is None:
            raise ValueError(f"{agg.function}({agg.column}) needs an order")
        # NULL values lose their place, and rows without a place are passed over.
        place = F.when(value.isNotNull(), order)
        return (F.min_by if agg.function == "first" else F.max_by)(value, place).alias(agg.output)
    if agg.function in ("sum", "avg") and not is_number(kind):
        value = value.cast("double") if not missing_is_zero else value
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg.function](value).alias(agg.output)
