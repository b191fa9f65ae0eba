"""Late rows, by a watermark that follows the rows one by one."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.columns import column
from weirflow.plans.ordering import PART, ROW, in_ranges, part_lookup

from .windows import event_time, seconds


def _marked(df: DataFrame, timestamp: str, order_by: list[str], lateness: str | float) -> tuple[DataFrame, Column]:
    """df in ranges of the arrival order, and whether a row is late: below the latest time so far, its own included, less the
    lateness. The ranges' latest times, one for each, come to the driver; no task sees all rows."""
    ranged = in_ranges(df, order_by, "watermark")
    if timestamp not in df.columns:
        column(df, timestamp)
    time = F.unix_micros(event_time(ranged, timestamp)[0].cast("timestamp"))
    latest = {r[PART]: r["t"] for r in ranged.groupBy(PART).agg(F.max(time).alias("t")).collect()}
    ends = [latest.get(i) for i in range(max(latest, default=-1) + 1)]
    before = dict(enumerate([None, *accumulate(ends, lambda a, b: a if b is None else b if a is None else max(a, b))][: len(ends)]))
    here = F.max(time).over(Window.partitionBy(PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0))
    # The watermark starts at the epoch and never goes back.
    mark = F.greatest(F.lit(0).cast("long"), F.greatest(part_lookup(before, "long"), here) - round(seconds(lateness) * 1_000_000))
    return ranged.withColumn("__weir_late", F.coalesce(time < mark, F.lit(False))), F.col("__weir_late")


def drop_late(df: DataFrame, timestamp: str, order_by: list[str], lateness: str | float = 10) -> DataFrame:
    """Rows that aren't late, in a batch whose order_by is the order of arrival."""
    marked, late = _marked(df, timestamp, order_by, lateness)
    return marked.filter(~late).select(*df.columns)


def late_rows(df: DataFrame, timestamp: str, order_by: list[str], lateness: str | float = 10) -> DataFrame:
    """The rows that drop_late() drops."""
    marked, late = _marked(df, timestamp, order_by, lateness)
    return marked.filter(late).select(*df.columns)
