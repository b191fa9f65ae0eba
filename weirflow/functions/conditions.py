"""Two dialects of conditions: a filter's single predicate, and a sink's boolean expression.

A filter's condition is one predicate: `field op value` with op of >= <= != == > <, `field in [a, b]`, or `field ~ 'pattern'`.
A row whose field is NULL never passes. Text is compared as numbers where both sides read as numbers.

A sink's condition is made of comparisons, and/or/not, names and constants. A missing or NULL field equals nothing but
None, so `x != 5` is true for it; orderings with NULL are false.
"""

from __future__ import annotations

import ast
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .columns import as_number, column, has_column, is_number, is_text

#: The comparison operators, longest first, so that >= isn't read as >.
COMPARISONS = (">=", "<=", "!=", "==", ">", "<")
_WORDS = {"null": None, "none": None, "true": True, "false": False}


def literal_value(text: str) -> Any:
    """A value as it is written: quoted text, null, true, false, a whole number, a number, or bare text."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _unquoted(text: str) -> str:
    """text with what stands in quotes blanked out, so that positions stay."""
    out, quote = [], ""
    for c in text:
        if quote:
            out.append(c if c == quote else " ")
            quote = "" if c == quote else quote
        else:
            out.append(c)
            quote = c if c in "'\"" else ""
    return "".join(out)


def _items(text: str) -> list[Any]:
    """A list's values; commas in quotes don't part them."""
    bare, out, begin = _unquoted(text), [], 0
    for end in [i for i, c in enumerate(bare) if c == ","] + [len(text)]:
        if text[begin:end].strip():
            out.append(literal_value(text[begin:end]))
        begin = end + 1
    return out


def parse_condition(text: str) -> tuple[str, str, Any]:
    """(field, operator, value) of a filter's condition; operators within quotes don't count."""
    bare = _unquoted(text)
    open_, close = bare.find("["), bare.rfind("]")
    head = bare[:open_].rstrip() if open_ >= 0 else ""
    if head.lower().endswith(" in") and bare[close + 1 :].strip() == "":
        return text[: len(head) - 3].strip(), "in", _items(text[open_ + 1 : close])
    at = bare.find("~")
    if at > 0 and not any(op in bare[:at] for op in COMPARISONS):
        pattern = text[at + 1 :].strip()
        if len(pattern) >= 2 and pattern[0] == pattern[-1] and pattern[0] in "'\"":
            return text[:at].strip(), "~", pattern[1:-1]
    found = min(((bare.find(op), i, op) for i, op in enumerate(COMPARISONS) if op in bare), default=None)
    if found and text[: found[0]].strip() and text[found[0] + len(found[2]) :].strip():
        return text[: found[0]].strip(), found[2], literal_value(text[found[0] + len(found[2]) :])
    raise ValueError(f"not a condition: {text!r}")


def _compare(op: str, left: Column, right: Column) -> Column:
    return {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right, "==": left == right, "!=": left != right}[op]


def _mixed(op: str) -> Column:
    """What comparing values of different kinds gives: they are unequal, and in no order."""
    return F.lit(op == "!=")


def _against(op: str, field: Column, kind: DataType, value: Any) -> Column:
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if is_text(kind):
        own = as_number(field)
        if number:
            return F.when(own.isNotNull(), _compare(op, own, F.lit(float(value)))).otherwise(_mixed(op))
        if isinstance(value, bool):
            return _mixed(op)
        try:
            other = float(value)
        except ValueError:
            return _compare(op, field, F.lit(value))
        return F.when(own.isNotNull(), _compare(op, own, F.lit(other))).otherwise(_compare(op, field, F.lit(value)))
    if is_number(kind) and isinstance(value, str):
        try:
            return _compare(op, field, F.lit(float(value)))
        except ValueError:
            return _mixed(op)
    return _compare(op, field, F.lit(value))


def filter_column(condition: str, schema: DataFrame | StructType) -> Column:
    """The condition as a column that is true or false, never NULL. A field that isn't there is NULL."""
    name, op, value = parse_condition(condition)
    if not has_column(schema, name):
        return F.lit(False)
    field, kind = column(schema, name)
    if op == "in":
        same = [v for v in value if v is not None and isinstance(v, str) == is_text(kind)]
        test = field.isin(*same) if same else F.lit(False)
    elif op == "~":
        test = field.cast("string").rlike(value)
    elif value is None:
        if op not in ("==", "!="):
            raise ValueError(f"null has no order: {condition!r}")
        return field.isNotNull() if op == "!=" else F.lit(False)
    else:
        test = _against(op, field, kind, value)
    # A plain comparison is already NULL, hence not true, for a NULL field, and can be pushed down to the scan as it is.
    return test if op == "in" or not is_text(kind) and op != "~" else field.isNotNull() & test


def sink_column(condition: str, schema: DataFrame | StructType) -> Column:
    """The condition as a column that is true or false."""
    try:
        tree = ast.parse(condition, mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not a condition: {condition!r}") from e
    return F.coalesce(_truth(tree, schema), F.lit(False))


_SINK_OPS = {ast.Gt: ">", ast.Lt: "<", ast.GtE: ">=", ast.LtE: "<=", ast.Eq: "==", ast.NotEq: "!="}


def _truth(node: ast.AST, schema: DataFrame | StructType) -> Column:
    if isinstance(node, ast.Compare):
        chain = [node.left, *node.comparators]
        out: Column | None = None
        for op, left, right in zip(node.ops, chain, chain[1:], strict=False):
            if type(op) not in _SINK_OPS:
                raise ValueError(f"not for conditions: {type(op).__name__}")
            one = _sink_compare(_SINK_OPS[type(op)], _value(left, schema), _value(right, schema))
            out = one if out is None else out & one
        return out
    if isinstance(node, ast.BoolOp):
        parts = [_truth(v, schema) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~_truth(node.operand, schema)
    value, kind, _ = _value(node, schema)
    if kind == "text":
        return F.length(value) > 0
    return value != 0 if kind == "number" else value


def _value(node: ast.AST, schema: DataFrame | StructType) -> tuple[Column, str, Any]:
    """A column, its kind, and the constant it is, if any."""
    if isinstance(node, ast.Name):
        if not has_column(schema, node.id):
            return F.lit(None), "null", None
        field, kind = column(schema, node.id)
        return field, "text" if is_text(kind) else "number" if is_number(kind) else "other", None
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
        return F.lit(-node.operand.value), "number", -node.operand.value
    if isinstance(node, ast.Constant):
        v = node.value
        return F.lit(v), "null" if v is None else "text" if isinstance(v, str) else "other" if isinstance(v, bool) else "number", v
    raise ValueError(f"not for conditions: {type(node).__name__}")


def _sink_compare(op: str, left: tuple, right: tuple) -> Column:
    (a, kind_a, _), (b, kind_b, _) = left, right
    if {kind_a, kind_b} == {"text", "number"}:
        return _mixed(op)
    if op == "==":
        return a.eqNullSafe(b)
    if op == "!=":
        return ~a.eqNullSafe(b)
    return _compare(op, a, b)
