"""Columns by name and kind, and text that is a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType


def column(df_or_schema: DataFrame | StructType, name: str) -> tuple[Column, DataType]:
    """The column of this very name (a dot in it is part of it, unless only a nested field fits) and its type."""
    schema = df_or_schema.schema if isinstance(df_or_schema, DataFrame) else df_or_schema
    if name in schema.names:
        return F.col(f"`{name.replace('`', '``')}`"), schema[name].dataType
    kind: DataType = schema
    for part in name.split("."):
        if not isinstance(kind, StructType) or part not in kind.names:
            raise KeyError(f"no column {name!r}; there are {', '.join(schema.names)}")
        kind = kind[part].dataType
    return F.col(".".join(f"`{p.replace('`', '``')}`" for p in name.split("."))), kind


def has_column(df_or_schema: DataFrame | StructType, name: str) -> bool:
    try:
        column(df_or_schema, name)
    except KeyError:
        return False
    return True


def is_text(kind: DataType) -> bool:
    return isinstance(kind, StringType)


def is_number(kind: DataType) -> bool:
    return isinstance(kind, NumericType)


def is_boolean(kind: DataType) -> bool:
    return isinstance(kind, BooleanType)


def is_collection(kind: DataType) -> bool:
    return isinstance(kind, ArrayType | MapType)


def as_number(text: Column) -> Column:
    """Text as a double, NULL where it isn't one."""
    return text.try_cast("double")
