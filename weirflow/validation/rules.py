"""Rules over fields, each an error column that is NULL where the rule holds."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.columns import column, has_column

from .schema import Validated, split


class Rule:
    """A named check. Subclasses give error(), a message or NULL."""

    def __init__(self, name: str):
        self.name = name

    def error(self, df: DataFrame) -> Column:
        raise NotImplementedError


def _field(df: DataFrame, name: str) -> Column:
    """The column, NULL where there is none of that name."""
    return column(df, name)[0] if has_column(df, name) else F.lit(None).cast("string")


class RangeRule(Rule):
    """A number, or text that is one, from low to high, both included. NaN passes; NULL doesn't."""

    def __init__(self, field: str, low: float = float("-inf"), high: float = float("inf"), name: str = ""):
        super().__init__(name or f"RangeRule({field})")
        self.field, self.low, self.high = field, low, high

    def error(self, df: DataFrame) -> Column:
        value = _field(df, self.field)
        number = value.try_cast("double")
        outside = ~F.isnan(number) & ((number < self.low) | (number > self.high))
        return F.when(value.isNull(), F.lit(f"{self.field} is missing")).when(number.isNull(), F.lit(f"{self.field} is not a number")).when(outside, F.lit(f"{self.field} is outside [{self.low}, {self.high}]"))


class NotNullRule(Rule):
    """Fields that are neither NULL nor empty text."""

    def __init__(self, fields: list[str], name: str = ""):
        if not fields:
            raise ValueError("no fields given")
        super().__init__(name or f"NotNullRule({', '.join(fields)})")
        self.fields = fields

    def error(self, df: DataFrame) -> Column:
        empty = F.array_compact(F.array(*(F.when(v.isNull() | (v.cast("string") == ""), F.lit(f)) for f in self.fields for v in [_field(df, f)])))
        return F.when(F.size(empty) > 0, F.concat(F.lit("null or empty: "), F.array_join(empty, ", ")))


class RegexRule(Rule):
    """Text all of which the pattern matches; other values by their text. NULL fails."""

    def __init__(self, field: str, pattern: str, name: str = ""):
        super().__init__(name or f"RegexRule({field})")
        self.field, self.pattern = field, pattern

    def error(self, df: DataFrame) -> Column:
        value = _field(df, self.field)
        fits = value.cast("string").rlike(rf"\A(?:{self.pattern})\z")
        return F.when(value.isNull(), F.lit(f"{self.field} is missing")).when(~fits, F.lit(f"{self.field} does not match {self.pattern}"))


class CustomRule(Rule):
    """A check of one's own: from the frame to an error column, or, with python=True, from a row as a dict to (passed, message)."""

    def __init__(self, name: str, check: Callable[[Any], Any], python: bool = False):
        if not callable(check):
            raise TypeError("check must be callable")
        super().__init__(name)
        self.check, self.python = check, python

    def error(self, df: DataFrame) -> Column:
        if not self.python:
            return self.check(df)
        check = self.check

        @F.udf("string", useArrow=True)
        def run(row) -> str | None:
            passed, message = check(row if isinstance(row, dict) else row.asDict(recursive=True))
            return None if passed else message or "failed"

        return run(F.struct(*(F.col(f"`{c}`") for c in df.columns)))


class RuleSet:
    """All rules at once. A row's error is "[rule] message" of each rule that it breaks, joined."""

    def __init__(self, rules: list[Rule]):
        self.rules = list(rules)

    def add(self, rule: Rule) -> RuleSet:
        self.rules.append(rule)
        return self

    def validate(self, df: DataFrame) -> Validated:
        return split(df, [F.concat(F.lit(f"[{r.name}] "), r.error(df)) for r in self.rules])
