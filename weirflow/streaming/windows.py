"""Aggregates over windows of event time, in batches and streams."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from weirflow.functions import aggregate_column, parse_aggregates
from weirflow.functions.aggregates import STREAM_AGGREGATES
from weirflow.functions.columns import column, has_column

#: Seconds of a unit.
UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}
START, END, COUNT = "_window_start", "_window_end", "_record_count"


def seconds(span: str | float) -> float:
    """Seconds of a span such as 60s, 5m or 1h, or of a number."""
    if isinstance(span, int | float):
        return float(span)
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d)?\s*", span)
    if not m:
        raise ValueError(f"not a span of time: {span!r}")
    return float(m[1]) * UNITS[m[2] or "s"]


@dataclass
class TimeWindow:
    """tumbling, sliding (slide: half the size if not given) or session (gap: the size if not given)."""

    type: str = "tumbling"
    size: str | float = 60
    slide: str | float | None = None
    gap: str | float | None = None

    def __post_init__(self):
        if self.type not in ("tumbling", "sliding", "session"):
            raise ValueError(f"no window {self.type!r}")
        self.size = seconds(self.size)
        self.slide = seconds(self.slide) if self.slide is not None else self.size / 2
        self.gap = seconds(self.gap) if self.gap is not None else self.size
        if min(self.size, self.slide, self.gap) <= 0:
            raise ValueError("sizes are over 0")


def _span(value: float) -> str:
    return f"{round(value * 1_000_000)} microseconds"


def event_time(df: DataFrame, name: str | None) -> tuple[Column, DataType]:
    """The time of each row: a timestamp, or epoch seconds as a number or text; now where there is none."""
    if not name or not has_column(df, name):
        return F.current_timestamp(), TimestampType()
    value, kind = column(df, name)
    if isinstance(kind, NumericType | StringType):
        return F.coalesce(F.timestamp_micros((value.cast("double") * 1_000_000).cast("long")), F.current_timestamp()), TimestampType()
    if df.isStreaming and isinstance(kind, TimestampNTZType):
        return value.cast("timestamp"), TimestampType()  # watermarks need a time with a zone
    return value, kind


def windowed_aggregate(df: DataFrame, window: TimeWindow, aggregations: dict[str, str], group_by: list[str] | None = None, timestamp: str | None = None, lateness: str | float | None = None, strict_sessions: bool = False) -> DataFrame:
    """A row for each window and group: START, END, the keys, the aggregates and COUNT.

    Times come back as the event time came: epoch seconds, or timestamps. sum and avg take NULL as 0. On a stream, lateness sets
    the watermark, which closes windows and drops rows that come after; on a batch, all windows are given.

    A session ends where no row came for gap seconds; END is the gap after its last row. strict_sessions (batch only) takes
    rows in the order of time: a row joins the first session whose end, at first gap after its start, plus gap isn't
    passed, and END is the later of that and its last row; a group then is one task's.
    """
    specs = parse_aggregates(aggregations, STREAM_AGGREGATES)
    keys = group_by or []
    time, _ = event_time(df, timestamp)
    numeric = bool(timestamp) and has_column(df, timestamp) and isinstance(column(df, timestamp)[1], NumericType | StringType)
    at = "__weir_time"
    rows = df.withColumn(at, time)
    if df.isStreaming:
        rows = rows.withWatermark(at, _span(seconds(lateness if lateness is not None else 10)))
    made = [aggregate_column(s, df, missing_is_zero=True) for s in specs] + [F.count(F.lit(1)).alias(COUNT)]
    by = [column(df, k)[0].alias(k) for k in keys]
    if window.type == "session" and strict_sessions:
        out = _with_strict_sessions(rows, at, keys, window.gap)
        out = out.groupBy(F.col(START), F.col(END), *by).agg(*made)
        return _times(out, keys, [s.output for s in specs], numeric)
    if window.type == "session":
        frame = F.session_window(at, _span(window.gap))
    elif window.type == "tumbling" or window.slide > window.size:
        # Where windows leave gaps, a row lies in the one that begins last, or in none.
        step = window.size if window.type == "tumbling" else window.slide
        frame = F.window(at, _span(step))
        if step != window.size:
            rows = rows.filter(F.col(at).cast("timestamp") < F.window(at, _span(step)).start.cast("timestamp") + F.expr(f"interval {_span(window.size)}"))
    else:
        frame = F.window(at, _span(window.size), _span(window.slide))
    out = rows.groupBy(frame.alias("w"), *by).agg(*made)
    end = F.col("w.end") if window.type != "sliding" or window.slide <= window.size else F.col("w.start") + F.expr(f"interval {_span(window.size)}")
    out = out.select(F.col("w.start").alias(START), end.alias(END), *keys, *(s.output for s in specs), COUNT)
    return _times(out, keys, [s.output for s in specs], numeric)


def _times(out: DataFrame, keys: list[str], outputs: list[str], numeric: bool) -> DataFrame:
    bound = (lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000).alias(c)) if numeric else F.col
    return out.select(bound(START), bound(END), *(F.col(f"`{k}`") for k in keys), *(F.col(f"`{o}`") for o in outputs), COUNT)


def _with_strict_sessions(rows: DataFrame, at: str, keys: list[str], gap: float) -> DataFrame:
    """rows with START and END by an ordered pass over each group, which has to fit into a task."""
    import pandas as pd

    kind = rows.schema[at].dataType
    schema = StructType([*rows.schema.fields, StructField(START, kind), StructField(END, kind)])
    width = pd.Timedelta(seconds=gap)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(at, kind="stable")
        mine: list[list] = []
        open_: list | None = None  # times ascend, so no earlier session can take a row any more
        for t in group[at]:
            if open_ is None or t > open_[1] + width:
                open_ = [t, t + width]
            open_[1] = max(open_[1], t)
            mine.append(open_)
        return group.assign(**{START: [s[0] for s in mine], END: [s[1] for s in mine]})[schema.names]

    return rows.groupBy(*(column(rows, k)[0] for k in keys)).applyInPandas(fold, schema)
