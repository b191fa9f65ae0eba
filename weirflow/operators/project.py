"""Filters and computed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weirflow.functions import filter_column, map_column


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    """Rows that pass one predicate; a NULL field never passes."""
    return df.filter(filter_column(condition, df))


def map_columns(df: DataFrame, columns: dict[str, str], drop_original: bool = False) -> DataFrame:
    """New or replaced columns. All expressions read the input's columns, none reads another's result."""
    if not columns:
        raise ValueError("no columns given")
    made = {name: map_column(expression, df) for name, expression in columns.items()}
    if drop_original:
        return df.select(*(c.alias(name) for name, c in made.items()))
    return df.withColumns(made)
