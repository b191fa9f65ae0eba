"""Records against a schema: fields are coerced, and rows that can't be are set apart."""

from __future__ import annotations

import types
import typing
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, DoubleType, IntegralType, LongType, StringType, StructField, StructType, TimestampType

from weirflow.functions.columns import column, has_column, is_boolean, is_number, is_text

ERRORS = "_errors"


@dataclass
class Validated:
    """Rows that pass, and rows that don't with their error in ERRORS, from one pass over the input each."""

    valid: DataFrame
    invalid: DataFrame

    def counts(self) -> DataFrame:
        """total, valid, invalid and pass_rate (0 for no rows), as one row."""
        both = self.valid.select(F.lit(True).alias("ok")).unionAll(self.invalid.select(F.lit(False).alias("ok")))
        return both.agg(F.count("*").alias("total"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"), F.coalesce(F.avg(F.col("ok").cast("int")), F.lit(0.0)).alias("pass_rate"))

    def merge(self, other: Validated) -> Validated:
        return Validated(self.valid.unionByName(other.valid, True), self.invalid.unionByName(other.invalid, True))


def split(df: DataFrame, errors: list[Column], separator: str = "; ") -> Validated:
    """Rows by whether any of the error columns is not NULL; messages are joined."""
    found = F.array_join(F.array_compact(F.array(*errors)), separator) if errors else F.lit("")
    marked = df.withColumn(ERRORS, found)
    return Validated(marked.filter(F.col(ERRORS) == "").drop(ERRORS), marked.filter(F.col(ERRORS) != ""))


_PYTHON: dict[type, DataType] = {str: StringType(), bool: BooleanType(), int: LongType(), float: DoubleType(), datetime: TimestampType(), date: DateType(), Decimal: DecimalType(38, 18)}


class RecordSchema:
    """Fields with types; a field is required unless it has a default or may be NULL.

    Text becomes numbers, true and false (also 1, 0, yes, no, on, off) or times where it reads as such. A number becomes a
    whole one only if it is one. Columns that the schema doesn't have are dropped. Constraints of a pydantic model are
    checked as far as they are bounds, lengths and patterns.
    """

    def __init__(self, fields: StructType, defaults: dict[str, Any] | None = None, bounds: dict[str, list] | None = None):
        self.fields, self.defaults, self.bounds = fields, defaults or {}, bounds or {}

    @classmethod
    def of_model(cls, model: type) -> RecordSchema:
        """The schema of a pydantic model's fields."""
        fields, defaults, bounds = [], {}, {}
        for name, info in model.model_fields.items():
            kind, nullable = _unwrap(info.annotation)
            if kind not in _PYTHON:
                raise TypeError(f"no column type for {name}: {info.annotation}")
            if not info.is_required():
                defaults[name] = info.get_default(call_default_factory=True)
            fields.append(StructField(name, _PYTHON[kind], nullable))
            bounds[name] = list(info.metadata)
        return cls(StructType(fields), defaults, bounds)

    def _cast(self, value: Column, have: DataType, want: DataType) -> Column:
        if is_text(want):
            return value if is_text(have) else F.lit(None).cast("string")
        if is_text(have):
            value = F.trim(value)
            if is_boolean(want):
                low = F.lower(value)
                return F.when(low.isin("true", "1", "yes", "on", "t", "y"), True).when(low.isin("false", "0", "no", "off", "f", "n"), False)
        if isinstance(want, IntegralType) and (is_number(have) or is_text(have)):
            # 3.0 is whole, 3.7 isn't.
            number = value.try_cast("double")
            return F.coalesce(value.try_cast("string").try_cast("long"), F.when(number == F.floor(number), number.try_cast("long")))
        return value.try_cast(want)

    def validate(self, df: DataFrame) -> Validated:
        made, errors = [], []
        for f in self.fields:
            if not has_column(df, f.name):
                made.append(F.lit(self.defaults.get(f.name)).cast(f.dataType).alias(f.name))
                if f.name not in self.defaults and not f.nullable:
                    errors.append(F.lit(f"{f.name}: field required"))
                continue
            value, kind = column(df, f.name)
            cast = self._cast(value, kind, f.dataType)
            name = f.dataType.typeName()
            if not f.nullable:
                errors.append(F.when(value.isNull(), F.lit(f"{f.name}: value is missing")))
            errors.append(F.when(value.isNotNull() & cast.isNull(), F.lit(f"{f.name}: not a valid {name}")))
            errors += [F.when(cast.isNotNull() & ~test, F.lit(f"{f.name}: {says}")) for test, says in self._tests(f.name, cast)]
            made.append(cast.alias(f.name))
        done = split(df, errors)
        return Validated(done.valid.select(*made), done.invalid)

    def validate_one(self, record: dict[str, Any], spark: SparkSession) -> tuple[dict[str, Any] | None, str | None]:
        """The coerced record and no error, or none and the error. For single records; frames go through validate()."""
        names = list(record) or ["__weir_empty"]
        row = spark.range(1).select(*(F.lit(record.get(n)).alias(n) for n in names))
        done = self.validate(row.select(*(F.col(f"`{n}`").cast("string").alias(n) if t == "void" else F.col(f"`{n}`") for n, t in row.dtypes)))
        if good := done.valid.first():
            return good.asDict(), None
        return None, done.invalid.first()[ERRORS]

    def _tests(self, name: str, value: Column) -> list[tuple[Column, str]]:
        out = []
        for b in self.bounds.get(name, []):
            for attribute, test in (
                ("gt", lambda v: value > v), ("ge", lambda v: value >= v), ("lt", lambda v: value < v), ("le", lambda v: value <= v),
                ("min_length", lambda v: F.length(value) >= v), ("max_length", lambda v: F.length(value) <= v), ("pattern", lambda v: value.rlike(v)),
            ):
                limit = getattr(b, attribute, None)
                if limit is not None:
                    out.append((test(limit), f"{attribute} {limit}"))
        return out


def _unwrap(annotation: Any) -> tuple[Any, bool]:
    """A type and whether None is one of its values."""
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        own = [a for a in typing.get_args(annotation) if a is not type(None)]
        return (own[0] if len(own) == 1 else annotation), len(own) < len(typing.get_args(annotation))
    return annotation, False
