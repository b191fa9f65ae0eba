"""Group-by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions import aggregate_column, parse_aggregates
from weirflow.functions.columns import column


def aggregate(df: DataFrame, group_by: list[str], aggregations: dict[str, str], order_by: list[str] | None = None) -> DataFrame:
    """One row a group; NULL keys are one group. first and last go by order_by, which should be unique.

    Without keys there is one row, and none if there is no input. Sums are partial before the shuffle.
    """
    specs = parse_aggregates(aggregations)
    order = None
    if order_by:
        keys = [column(df, c)[0] for c in order_by]
        order = keys[0] if len(keys) == 1 else F.struct(*keys)
    made = [aggregate_column(s, df, order) for s in specs]
    if group_by:
        return df.groupBy(*(column(df, c)[0].alias(c) for c in group_by)).agg(*made)
    rows = "__weir_rows"
    return df.agg(*made, F.count(F.lit(1)).alias(rows)).filter(F.col(rows) > 0).drop(rows)
