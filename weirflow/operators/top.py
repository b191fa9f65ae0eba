"""The first rows of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weirflow.functions.columns import column


def top_n(df: DataFrame, order_by: list[str], n: int, descending: bool = True, where: str | None = None) -> DataFrame:
    """n rows; each task keeps n of its own first. where: a filter's condition."""
    from .project import filter_rows

    df = filter_rows(df, where) if where else df
    keys = [column(df, c)[0] for c in order_by]
    return df.orderBy(*(k.desc() if descending else k.asc() for k in keys)).limit(n)
