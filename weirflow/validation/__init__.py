"""Schemas, rules and what happens to rows that break them."""

from .dead_letter import DeadLetters
from .json_schema import JSONSchema, errors_of_json
from .rules import CustomRule, NotNullRule, RangeRule, RegexRule, Rule, RuleSet
from .schema import RecordSchema, Validated

__all__ = ["CustomRule", "DeadLetters", "JSONSchema", "NotNullRule", "RangeRule", "RecordSchema", "RegexRule", "Rule", "RuleSet", "Validated", "errors_of_json"]
