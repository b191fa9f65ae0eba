"""One row for each id."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weirflow.functions.columns import column
from weirflow.operators.dedup import deduplicate

from .windows import _span, event_time, seconds


def first_by_id(df: DataFrame, id_field: str, order_by: list[str] | None = None) -> DataFrame:
    """The first row of each id; rows whose id is NULL or empty text go. On a stream, the first that comes, for ever."""
    value, _ = column(df, id_field)
    named = df.filter(value.isNotNull() & (value.cast("string") != ""))
    return named.dropDuplicates([id_field]) if df.isStreaming else deduplicate(named, [id_field], "first", order_by)


def first_by_id_within(df: DataFrame, id_field: str, timestamp: str, span: str | float) -> DataFrame:
    """On a stream, the first row of each id within a span of event time, after which the id is forgotten."""
    value, _ = column(df, id_field)
    named = df.filter(value.isNotNull() & (value.cast("string") != "")).withColumn("__weir_time", event_time(df, timestamp)[0])
    return named.withWatermark("__weir_time", _span(seconds(span))).dropDuplicatesWithinWatermark([id_field]).drop("__weir_time")
