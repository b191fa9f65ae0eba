from __future__ import annotations

import pytest
from pydantic import BaseModel, Field
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weirflow.validation import CustomRule, JSONSchema, NotNullRule, RangeRule, RecordSchema, RegexRule, RuleSet, errors_of_json


class User(BaseModel):
    name: str
    age: int = Field(ge=0)
    email: str | None = None
    score: float = 1.5


def test_records_are_coerced_and_split(spark):
    data = [("Al", "30", "a@x", "z"), ("Bo", "xyz", None, "z"), ("Cy", "3.0", None, "z"), (None, "1", None, "z"), ("Di", "-4", None, "z"), ("Ed", "3.7", None, "z")]
    done = RecordSchema.of_model(User).validate(spark.createDataFrame(data, "name string, age string, email string, extra string"))
    assert [tuple(r) for r in done.valid.collect()] == [("Al", 30, "a@x", 1.5), ("Cy", 3, None, 1.5)]
    errors = {r.age: r._errors for r in done.invalid.collect()}
    assert set(errors) == {"xyz", "1", "-4", "3.7"} and "age" in errors["xyz"] and "name" in errors["1"] and "ge 0" in errors["-4"]
    assert done.counts().first().asDict() == {"total": 6, "valid": 2, "invalid": 4, "pass_rate": pytest.approx(1 / 3)}
    assert done.merge(done).counts().first().total == 12


def test_missing_columns_and_nothing(spark):
    done = RecordSchema.of_model(User).validate(spark.createDataFrame([("A",)], "name string"))
    assert done.valid.count() == 0 and "age: field required" in done.invalid.first()._errors
    assert RecordSchema.of_model(User).validate(spark.createDataFrame([], "name string, age int")).counts().first().pass_rate == 0.0


def test_rules(spark):
    nan = float("nan")
    data = [(1, 5.0, "ab1", "x"), (2, 11.0, "ab1", "x"), (3, None, "ab1", "x"), (4, nan, "ab1", "x"), (5, 0.0, "zab1", ""), (6, 10.0, None, " ")]
    df = spark.createDataFrame(data, "id int, v double, code string, note string")
    rules = RuleSet([RangeRule("v", 0, 10), RegexRule("code", "ab[0-9]"), NotNullRule(["note"])])
    done = rules.validate(df)
    assert [r.id for r in done.valid.collect()] == [1, 4]
    errors = {r.id: r._errors for r in done.invalid.collect()}
    assert errors[2].startswith("[RangeRule(v)]") and errors[3].endswith("v is missing") and errors[5].count("Rule(") == 2 and "; " in errors[5]
    text = df.select(F.lit("7").alias("v"), F.lit("x").alias("w"))
    assert RuleSet([RangeRule("v", 0, 10)]).validate(text).invalid.count() == 0
    assert RuleSet([RangeRule("w", 0, 10)]).validate(text).valid.count() == 0
    assert RuleSet([NotNullRule(["nothing"])]).validate(text).valid.count() == 0
    assert RuleSet([]).validate(df).valid.count() == 6
    with pytest.raises(ValueError):
        NotNullRule([])


def test_rules_of_ones_own(spark):
    df = spark.range(4)
    columns = CustomRule("even", lambda d: F.when(d.id % 2 != 0, F.lit("odd")))
    python = CustomRule("small", lambda row: (row["id"] < 2, "too large"), python=True)
    done = RuleSet([columns]).add(python).validate(df)
    assert {r.id: r._errors for r in done.invalid.collect()} == {1: "[even] odd", 2: "[small] too large", 3: "[even] odd; [small] too large"}
    with pytest.raises(TypeError):
        CustomRule("no", "x")


SENSOR = {"type": "object", "required": ["id", "level"], "properties": {"id": {"type": "string", "pattern": "^sn"}, "level": {"type": "number", "minimum": 0}, "kind": {"enum": ["a", 1, None, True]}, "at": {"type": "object", "required": ["lat"], "properties": {"lat": {"type": "number"}}}, "tags": {"type": "array", "items": {"type": "string"}, "maxItems": 2}, "n": {"type": ["integer", "null"]}}, "additionalProperties": False}


@pytest.mark.parametrize(
    ("text", "valid"),
    [
        ('{"id": "sn1", "level": 100}', True),
        ('{"id": "sn1"}', False),
        ('{"id": "sn1", "level": "not-a-number"}', False),
        ('{"id": "sn1", "level": -5}', False),
        ('{"id": "sn1", "level": 0.5, "extra": 1}', False),
        ('{"id": "an1", "level": 1}', False),
        ('{"id": 7, "level": 1}', False),
        ('{"id": "sn", "level": 1, "kind": null}', True),
        ('{"id": "sn", "level": 1, "kind": true}', True),
        ('{"id": "sn", "level": 1, "kind": "b"}', False),
        ('{"id": "sn", "level": 1, "kind": 1}', True),
        ('{"id": "sn", "level": 1, "at": {"lat": 1.5}}', True),
        ('{"id": "sn", "level": 1, "at": {}}', False),
        ('{"id": "sn", "level": 1, "at": {"lat": "x"}}', False),
        ('{"id": "sn", "level": 1, "tags": ["a", "b"]}', True),
        ('{"id": "sn", "level": 1, "tags": ["a", 2]}', False),
        ('{"id": "sn", "level": 1, "tags": ["a", "b", "c"]}', False),
        ('{"id": "sn", "level": 1, "n": null}', True),
        ('{"id": "sn", "level": 1, "n": 2.5}', False),
        ("[1]", False),
        ("no json", False),
        (None, False),
    ],
)
def test_json_schema(spark, text, valid):
    done = JSONSchema(SENSOR).validate(spark.createDataFrame([(text,)], "value string"))
    assert (done.valid.count(), done.invalid.count()) == ((1, 0) if valid else (0, 1))


def test_json_schema_of_rows(spark):
    df = spark.createDataFrame([("sn1", 5.0, 1), ("sn2", -1.0, 2)], "id string, level double, _meta int")
    done = JSONSchema(SENSOR).validate_rows(df)
    assert done.valid.collect() == [("sn1", 5.0, 1)] and "minimum" in done.invalid.first()._errors
    assert done.valid.columns == df.columns


def test_keywords_that_are_not_checked_are_errors():
    with pytest.raises(ValueError):
        errors_of_json(F.lit("{}"), {"patternProperties": {}})
    with pytest.raises(ValueError):
        errors_of_json(F.lit("{}"), {"properties": {"a": {"$ref": "#"}}})


COMBINED = {
    "definitions": {"small": {"type": "integer", "maximum": 9}},
    "properties": {
        "any": {"anyOf": [{"$ref": "#/definitions/small"}, {"type": "string"}]},
        "one": {"oneOf": [{"minimum": 3}, {"maximum": 5}]},
        "all": {"allOf": [{"minimum": 3}, {"maximum": 5}]},
        "no": {"not": {"type": "null"}},
        "list": {"type": "array", "items": {"type": "object", "required": ["x"], "properties": {"x": {"$ref": "#/definitions/small"}}}},
        "map": {"properties": {"known": {"type": "string"}}, "additionalProperties": {"type": "boolean"}},
    },
}


@pytest.mark.parametrize(
    ("text", "valid"),
    [
        ("{}", True), ('{"any": 9}', True), ('{"any": "x"}', True), ('{"any": 10}', False), ('{"one": 2}', True), ('{"one": 4}', False), ('{"one": 6}', True), ('{"all": 4}', True),
        ('{"all": 6}', False), ('{"no": 1}', True), ('{"no": null}', False), ('{"list": [{"x": 1}, {"x": 2, "y": 0}]}', True), ('{"list": [{"x": 1}, {}]}', False),
        ('{"list": [{"x": 10}]}', False), ('{"list": [3]}', False), ('{"map": {"known": "a", "b": true}}', True), ('{"map": {"b": 1}}', False), ('{"map": {"known": 1}}', False),
    ],
)
def test_schemas_that_combine_others(spark, text, valid):
    done = JSONSchema(COMBINED).validate(spark.createDataFrame([(text,)], "value string"))
    assert (done.valid.count(), done.invalid.count()) == ((1, 0) if valid else (0, 1))


AVRO = {
    "type": "record", "name": "r", "fields": [
        {"name": "id", "type": "int"}, {"name": "word", "type": ["null", "string"], "default": None}, {"name": "kind", "type": {"type": "enum", "name": "k", "symbols": ["a", "b"]}},
        {"name": "tags", "type": {"type": "array", "items": "string"}, "default": []}, {"name": "more", "type": {"type": "map", "values": "double"}, "default": {}},
        {"name": "other", "type": ["null", "k"], "default": None}],
}


@pytest.mark.parametrize(
    ("text", "valid"),
    [
        ('{"id": 1, "kind": "a"}', True), ('{"id": 3000000000, "kind": "a"}', False), ('{"id": 1}', False), ('{"id": 1, "kind": "c"}', False), ('{"id": 1, "kind": "a", "word": null, "tags": ["x"]}', True),
        ('{"id": 1, "kind": "a", "word": 2}', False), ('{"id": 1, "kind": "a", "tags": [1]}', False), ('{"id": 1, "kind": "b", "more": {"z": 1.5}, "other": "b"}', True), ('{"id": 1, "kind": "b", "other": "z"}', False),
    ],
)
def test_avro_schemas(spark, text, valid):
    done = JSONSchema(AVRO, type="avro").validate(spark.createDataFrame([(text,)], "value string"))
    assert (done.valid.count(), done.invalid.count()) == ((1, 0) if valid else (0, 1))


def test_one_record(spark):
    schema = RecordSchema(StructType([StructField("name", StringType(), False), StructField("age", LongType(), False)]), {"age": 7})
    assert schema.validate_one({"name": "x", "age": "30", "more": 1}, spark) == ({"name": "x", "age": 30}, None)
    assert schema.validate_one({"name": "x"}, spark) == ({"name": "x", "age": 7}, None)
    good, error = schema.validate_one({"name": None, "age": "old"}, spark)
    assert good is None and "name: value is missing" in error and "age: not a valid" in error


def test_fingerprints_ignore_the_order_of_keys():
    assert JSONSchema({"a": 1, "b": 2}).fingerprint() == JSONSchema({"b": 2, "a": 1}).fingerprint() != JSONSchema({"a": 2}).fingerprint()
