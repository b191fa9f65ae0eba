"""Joins of streams within a span of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.columns import column

from .windows import _span, event_time, seconds


def interval_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str, within: str | float = 300, lateness: str | float = 10) -> DataFrame:
    """Pairs of equal keys, as text, whose times are at most so far apart. A column of both sides is the right side's.

    A batch is joined by key and bucket of time: a left row goes to its bucket and its two neighbours, so a frequent key
    is dealt out over time. Streams are joined with watermarks, which let state go. A NULL key matches nothing.
    """
    span = seconds(within)
    a = left.withColumns({"__weir_k": column(left, left_key)[0].cast("string"), "__weir_t": event_time(left, left_time)[0]})
    b = right.withColumns({"__weir_rk": column(right, right_key)[0].cast("string"), "__weir_rt": event_time(right, right_time)[0]})
    kept = [F.col(f"l.`{c}`") for c in left.columns if c not in right.columns] + [F.col(f"r.`{c}`") for c in right.columns]
    if left.isStreaming or right.isStreaming:
        a = a.withWatermark("__weir_t", _span(seconds(lateness))).alias("l")
        b = b.withWatermark("__weir_rt", _span(seconds(lateness))).alias("r")
        near = F.expr(f"__weir_rt >= __weir_t - interval {_span(span)} and __weir_rt <= __weir_t + interval {_span(span)}")
        return a.join(b, (F.col("__weir_k") == F.col("__weir_rk")) & near).select(*kept)
    width = max(1, round(span * 1_000_000))
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width).cast("long")
    a = a.withColumn("__weir_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket("__weir_t") + d))).alias("l")
    b = b.withColumn("__weir_rb", bucket("__weir_rt")).alias("r")
    apart = F.abs(F.unix_micros(F.col("__weir_t").cast("timestamp")) - F.unix_micros(F.col("__weir_rt").cast("timestamp")))
    return a.join(b, (F.col("__weir_k") == F.col("__weir_rk")) & (F.col("__weir_b") == F.col("__weir_rb")) & (apart <= width)).select(*kept)
