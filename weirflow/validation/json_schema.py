"""JSON text against a JSON Schema, by columns.

The text is parsed once, into a variant; what a schema says of a value becomes error columns over the part of the variant that
holds it, at any depth. Checked are type, required, properties, additionalProperties, enum, const, pattern, minimum, maximum,
exclusiveMinimum, exclusiveMaximum, minLength, maxLength, items, minItems, maxItems, anyOf, oneOf, allOf, not and $ref into
the schema itself, as far as it doesn't lead back to where it stands. Another keyword that would restrict values is an error
when the schema is read, so nothing passes by being overlooked. Avro schemas are read as the JSON Schema that says the same.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import Validated, split

#: Keywords that restrict nothing.
NOTES = {"$schema", "$id", "title", "description", "default", "examples", "$comment", "format"}
LISTS = {"$defs", "definitions"}
KNOWN = {"anyOf", "oneOf", "allOf", "not", "$ref", "type", "required", "properties", "additionalProperties", "enum", "const", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "items", "minItems", "maxItems"}


#: How deep references may lead.
DEPTH = 24


def _path(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, VOID for a null, NULL for what isn't there."""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def _is(kind: Column, number: Column, name: str) -> Column:
    tests = {
        "object": kind == "OBJECT",
        "array": kind == "ARRAY",
        "string": kind == "STRING",
        "boolean": kind == "BOOLEAN",
        "null": kind == "VOID",
        "number": kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"),
        "integer": (kind == "BIGINT") | kind.isin("DOUBLE", "DECIMAL", "FLOAT") & (number == F.floor(number)),
    }
    if name not in tests:
        raise ValueError(f"no JSON type {name!r}")
    return tests[name]


def _resolved(schema: dict[str, Any], root: dict[str, Any], depth: int) -> dict[str, Any]:
    """The schema, or what its reference names."""
    while "$ref" in schema:
        ref = schema["$ref"]
        if not ref.startswith("#") or depth > DEPTH:
            raise ValueError(f"a reference that isn't checked: {ref}")
        target: Any = root
        for part in filter(None, ref[1:].split("/")):
            target = target[part.replace("~1", "/").replace("~0", "~")]
        more = {k: v for k, v in schema.items() if k != "$ref"}
        schema, depth = {"allOf": [target, more]} if more else target, depth + 1
    return schema


def _holds(errors: list[Column]) -> Column:
    return F.coalesce(*errors).isNull() if errors else F.lit(True)


def _errors(value: Column, schema: dict[str, Any] | bool, where: str, root: dict[str, Any], depth: int = 0) -> list[Column]:
    """Error columns, NULL where the variant, which may be missing, holds to the schema."""
    if depth > DEPTH:
        raise ValueError("a schema that refers to itself isn't checked")
    if isinstance(schema, bool):
        return [] if schema else [F.when(value.isNotNull(), F.lit(f"{where}: not allowed"))]
    schema = _resolved(schema, root, depth)
    unknown = set(schema) - KNOWN - NOTES - LISTS
    if unknown:
        raise ValueError(f"keywords that aren't checked: {', '.join(sorted(unknown))}")
    kind = _kind(value)
    there = value.isNotNull()
    number = F.try_variant_get(value, "$", "double")
    words = F.try_variant_get(value, "$", "string")
    out: list[Column] = []

    def fail(test: Column, says: str) -> None:
        out.append(F.when(test, F.lit(f"{where}: {says}")))

    def below(part: Column, of: dict[str, Any] | bool, name: str = where) -> list[Column]:
        return _errors(part, of, name, root, depth + 1)

    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = F.lit(False)
        for n in names:
            fits = fits | _is(kind, number, n)
        fail(there & ~fits, f"not of type {', '.join(names)}")
    numeric, textual = there & _is(kind, number, "number"), there & (kind == "STRING")
    for key, test in (("minimum", lambda v: number < v), ("maximum", lambda v: number > v), ("exclusiveMinimum", lambda v: number <= v), ("exclusiveMaximum", lambda v: number >= v)):
        if key in schema:
            fail(numeric & test(schema[key]), f"{key} {schema[key]}")
    for key, test in (("pattern", lambda v: ~words.rlike(v)), ("minLength", lambda v: F.length(words) < v), ("maxLength", lambda v: F.length(words) > v)):
        if key in schema:
            fail(textual & test(schema[key]), f"{key} {schema[key]}")
    values = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if values is not None:
        fits = F.lit(False)
        for v in values:
            same = kind == "VOID" if v is None else (kind == "BOOLEAN") & (words == str(v).lower()) if isinstance(v, bool) else textual & (words == v) if isinstance(v, str) else numeric & (number == v)
            fits = fits | same
        fail(there & ~fits, f"not one of {json.dumps(values)}")
    is_object = there & (kind == "OBJECT")
    part = lambda name: F.try_variant_get(value, _path(name), "variant")
    for name in schema.get("required", []):
        fail(is_object & part(name).isNull(), f"{name} is required")
    extra = schema.get("additionalProperties", True)
    declared = list(schema.get("properties", {}))
    if extra is not True and extra != {}:
        held = F.try_variant_get(value, "$", "map<string,variant>")
        more = F.array_except(F.map_keys(held), F.lit(declared).cast("array<string>")) if declared else F.map_keys(held)
        if extra is False:
            out.append(F.when(is_object & (F.size(more) > 0), F.concat(F.lit(f"{where}: undeclared "), F.array_join(F.array_sort(more), ", "))))
        else:
            fail(is_object & F.exists(more, lambda k: ~_holds(below(F.element_at(held, k), extra))), "an undeclared field breaks its schema")
    for name, of in schema.get("properties", {}).items():
        out += [F.when(is_object, e) for e in below(part(name), of, name if where == "record" else f"{where}.{name}")]
    if {"items", "minItems", "maxItems"} & set(schema):
        listed = F.try_variant_get(value, "$", "array<variant>")
        is_array = there & (kind == "ARRAY")
        for key, test in (("minItems", lambda v: F.size(listed) < v), ("maxItems", lambda v: F.size(listed) > v)):
            if key in schema:
                fail(is_array & test(schema[key]), f"{key} {schema[key]}")
        if schema.get("items", True) is not True:
            fail(is_array & F.exists(listed, lambda v: ~_holds(below(v, schema["items"]))), "an item breaks its schema")
    for of in schema.get("allOf", []):
        out += below(value, of)
    if "anyOf" in schema:
        fits = F.lit(False)
        for of in schema["anyOf"]:
            fits = fits | _holds(below(value, of))
        fail(there & ~fits, "fits none of anyOf")
    if "oneOf" in schema:
        fits = F.lit(0)
        for of in schema["oneOf"]:
            fits = fits + _holds(below(value, of)).cast("int")
        fail(there & (fits != 1), "doesn't fit exactly one of oneOf")
    if "not" in schema:
        fail(there & _holds(below(value, schema["not"])), "fits what it must not")
    return out


def errors_of_json(text: Column, schema: dict[str, Any]) -> list[Column]:
    """One column of joined errors, NULL where the text holds to the schema."""
    _errors(F.lit(None).cast("variant"), schema, "record", schema)  # what can't be checked is an error here already

    def of(value: Column) -> Column:
        broken = F.when(value.isNull(), F.lit("record: not JSON"))
        return F.nullif(F.array_join(F.array_compact(F.array(broken, *_errors(value, schema, "record", schema))), "; "), F.lit(""))

    # In a lambda, the parsed text stands for itself wherever it is used; elsewhere it would be parsed for each use.
    return [F.get(F.transform(F.array(F.try_parse_json(text)), of), 0)]


#: Avro's plain types and what they are in JSON; whole numbers have the bounds of their size.
AVRO_TYPES: dict[str, dict[str, Any]] = {
    "null": {"type": "null"}, "boolean": {"type": "boolean"}, "float": {"type": "number"}, "double": {"type": "number"}, "string": {"type": "string"}, "bytes": {"type": "string"},
    "int": {"type": "integer", "minimum": -(2**31), "maximum": 2**31 - 1}, "long": {"type": "integer", "minimum": -(2**63), "maximum": 2**63 - 1},
}


def json_schema_of_avro(schema: Any, names: dict[str, Any] | None = None) -> dict[str, Any]:
    """The JSON Schema of the records that an Avro schema takes. A field with a default may be left out, others may not."""
    names = {} if names is None else names
    if isinstance(schema, list):
        return {"anyOf": [json_schema_of_avro(s, names) for s in schema]}
    if isinstance(schema, str):
        if schema in AVRO_TYPES:
            return AVRO_TYPES[schema]
        if schema not in names:
            raise ValueError(f"no Avro type {schema!r}")
        return names[schema]
    kind = schema["type"]
    if kind == "record":
        fields = {f["name"]: json_schema_of_avro(f["type"], names) for f in schema["fields"]}
        made: dict[str, Any] = {"type": "object", "properties": fields, "required": [f["name"] for f in schema["fields"] if "default" not in f]}
    elif kind == "enum":
        made = {"enum": list(schema["symbols"])}
    elif kind == "array":
        made = {"type": "array", "items": json_schema_of_avro(schema["items"], names)}
    elif kind == "map":
        made = {"type": "object", "additionalProperties": json_schema_of_avro(schema["values"], names)}
    elif kind == "fixed":
        made = {"type": "string", "minLength": schema["size"], "maxLength": schema["size"]}
    else:
        made = json_schema_of_avro(kind, names)
    if "name" in schema:
        names[schema["name"]] = made
    return made


@dataclass
class JSONSchema:
    """A schema of a subject; type is json or avro. Records are JSON text, so that what a schema doesn't declare is seen as well."""

    schema: dict[str, Any]
    subject: str = ""
    version: int = 1
    id: int = 0
    type: str = "json"
    extra: dict = field(default_factory=dict)

    def fingerprint(self) -> str:
        """SHA-256 of the schema, its keys sorted, without spaces."""
        return hashlib.sha256(json.dumps(self.schema, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def validate(self, df: DataFrame, column: str = "value") -> Validated:
        return split(df, errors_of_json(F.col(column), json_schema_of_avro(self.schema) if self.type == "avro" else self.schema))

    def validate_rows(self, df: DataFrame) -> Validated:
        """Rows of a frame, by their JSON; NULL fields count as not there, and columns that begin with _ as not part of it."""
        held = "__weir_json"
        marked = df.withColumn(held, F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("_")))))
        done = self.validate(marked, held)
        return Validated(done.valid.drop(held), done.invalid.drop(held))

    @classmethod
    def load(cls, path: str, **more) -> JSONSchema:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f), **more)
