"""Map expressions: arithmetic, names, constants, conditionals and a fixed set of functions, as columns."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FractionalType, IntegralType, LongType, MapType, NullType, StringType, StructType, TimestampType

from .columns import column, is_number, is_text
from .conditions import _compare

Typed = tuple[Column, DataType]


def _int(x: Typed) -> Typed:
    return x[0].cast("long"), LongType()


def _float(x: Typed) -> Typed:
    return x[0].cast("double"), DoubleType()


def _str(x: Typed) -> Typed:
    return x[0].cast("string"), StringType()


def _strip(x: Typed) -> Typed:
    return F.regexp_replace(x[0].cast("string"), r"(?U)^\s+|\s+$", ""), StringType()


def _round(x: Typed, digits: Typed | None = None) -> Typed:
    """Half to even. Without digits, a whole number."""
    if digits is None:
        return F.bround(x[0].cast("double"), 0).cast("long"), LongType()
    return F.bround(x[0], digits[0]), x[1] if isinstance(x[1], IntegralType) else DoubleType()


def _len(x: Typed) -> Typed:
    if isinstance(x[1], ArrayType | MapType):
        return F.size(x[0]), LongType()
    return F.length(x[0].cast("string")), LongType()


#: The functions of map expressions; NULL gives NULL.
SCALARS: dict[str, Callable[..., Typed]] = {
    "int": _int,
    "float": _float,
    "str": _str,
    "upper": lambda x: (F.upper(x[0].cast("string")), StringType()),
    "lower": lambda x: (F.lower(x[0].cast("string")), StringType()),
    "strip": _strip,
    "round": _round,
    "len": _len,
    "abs": lambda x: (F.abs(x[0]), x[1]),
    "now": lambda: (F.current_timestamp(), TimestampType()),
}


def _number(x: Typed) -> Typed:
    """Text counts as a number in arithmetic, as cells of text files are text; text that isn't one is an error."""
    return (x[0].cast("double"), DoubleType()) if is_text(x[1]) else x


def _wider(a: DataType, b: DataType) -> DataType:
    return DoubleType() if isinstance(a, FractionalType) or isinstance(b, FractionalType) else LongType()


def _add(a: Typed, b: Typed) -> Typed:
    if is_text(a[1]) and is_text(b[1]):
        return F.concat(a[0], b[0]), StringType()
    return (_number(a)[0] + _number(b)[0]), _wider(_number(a)[1], _number(b)[1])


def _times(a: Typed, b: Typed) -> Typed:
    for text, n in ((a, b), (b, a)):
        if is_text(text[1]) and isinstance(n[1], IntegralType):
            # A column of text times a whole number: numbers in text are multiplied, other text is repeated.
            return (F.repeat(text[0], n[0].cast("int")), StringType()) if text[2:] else (_number(text)[0] * n[0], DoubleType())
    return _number(a)[0] * _number(b)[0], _wider(_number(a)[1], _number(b)[1])


_BINARY: dict[type, Callable[[Typed, Typed], Typed]] = {
    ast.Add: _add,
    ast.Sub: lambda a, b: (_number(a)[0] - _number(b)[0], _wider(_number(a)[1], _number(b)[1])),
    ast.Mult: _times,
    ast.Div: lambda a, b: (_number(a)[0].cast("double") / _number(b)[0].cast("double"), DoubleType()),
}
_COMPARE = {ast.Gt: ">", ast.Lt: "<", ast.GtE: ">=", ast.LtE: "<=", ast.Eq: "==", ast.NotEq: "!="}


def map_column(expression: str, schema: DataFrame | StructType) -> Column:
    """The expression as a column. All names are the input's; an unknown one is an error here, not at run time."""
    try:
        tree = ast.parse(expression.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an expression: {expression!r}") from e
    return _compile(tree, schema.schema if isinstance(schema, DataFrame) else schema)[0]


def _compile(node: ast.AST, schema: StructType) -> Typed:
    if isinstance(node, ast.Constant):
        return _constant(node.value)
    if isinstance(node, ast.Name):
        return column(schema, node.id)
    if isinstance(node, ast.Attribute):
        return column(schema, _dotted(node))
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        left, right = _compile(node.left, schema), _compile(node.right, schema)
        if isinstance(node.op, ast.Mult):  # constant text is repeated, never read as a number
            left, right = (x + (True,) if isinstance(n, ast.Constant) and isinstance(n.value, str) or _is_words(n, schema) else x for x, n in ((left, node.left), (right, node.right)))
        return _BINARY[type(node.op)](left, right)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
        x = _number(_compile(node.operand, schema))
        return (-x[0] if isinstance(node.op, ast.USub) else x[0]), x[1]
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~_truth(node.operand, schema), BooleanType()
    if isinstance(node, ast.BoolOp):
        out = _truth(node.values[0], schema)
        for v in node.values[1:]:
            out = out & _truth(v, schema) if isinstance(node.op, ast.And) else out | _truth(v, schema)
        return out, BooleanType()
    if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
        chain = [_compile(n, schema) for n in (node.left, *node.comparators)]
        out = None
        for op, a, b in zip(node.ops, chain, chain[1:], strict=False):
            if is_text(a[1]) != is_text(b[1]) and (is_number(a[1]) or is_number(b[1])):
                a, b = _number(a), _number(b)
            one = _compare(_COMPARE[type(op)], a[0], b[0])
            out = one if out is None else out & one
        return out, BooleanType()
    if isinstance(node, ast.IfExp):
        yes, no = _compile(node.body, schema), _compile(node.orelse, schema)
        kind = no[1] if isinstance(yes[1], NullType) else yes[1] if isinstance(no[1], NullType) or type(yes[1]) is type(no[1]) else _wider(yes[1], no[1])
        return F.when(_truth(node.test, schema), yes[0]).otherwise(no[0]), kind
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        if node.func.id not in SCALARS:
            raise ValueError(f"no function {node.func.id!r}; there are {', '.join(SCALARS)}")
        if node.keywords:
            raise ValueError(f"{node.func.id} takes no named arguments")
        return SCALARS[node.func.id](*(_compile(a, schema) for a in node.args))
    raise ValueError(f"not for expressions: {ast.unparse(node)!r}")


def _is_words(node: ast.AST, schema: StructType) -> bool:
    """Whether this is text by construction, such as upper(name), and not a cell that may hold a number."""
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("str", "upper", "lower", "strip")


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    if isinstance(node, ast.Name):
        return node.id
    raise ValueError(f"not for expressions: {ast.unparse(node)!r}")


def _constant(value: object) -> Typed:
    kinds = {bool: BooleanType(), int: LongType(), float: DoubleType(), str: StringType(), type(None): NullType()}
    if type(value) not in kinds:
        raise ValueError(f"not for expressions: {value!r}")
    return F.lit(value), kinds[type(value)]


def _truth(node: ast.AST, schema: StructType) -> Column:
    value, kind = _compile(node, schema)[:2]
    if isinstance(kind, BooleanType):
        return value
    return F.length(value) > 0 if is_text(kind) else value != 0
