import json

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import schemas

NORM = {
    "$defs": {"span": {"type": "string", "pattern": "^span:[a-z]+", "minLength": 6}, "unit": {"type": "number", "minimum": 0, "maximum": 1}},
    "type": "object", "required": ["id", "actor", "confidence"],
    "properties": {
        "id": {"type": "string", "minLength": 1}, "actor": {"enum": ["provider", "deployer", None]}, "confidence": {"$ref": "#/$defs/unit"}, "inferred": {"type": "boolean"},
        "spans": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"$ref": "#/$defs/span"}}, "note": {"type": ["string", "null"], "maxLength": 5}, "count": {"type": "integer", "exclusiveMinimum": 0},
    },
    "additionalProperties": False,
    "allOf": [{"if": {"properties": {"inferred": {"const": True}}, "required": ["inferred"]}, "then": {"required": ["spans"]}}],
}
CASES = [
    ({"id": "n", "actor": "provider", "confidence": 0.5}, []),
    ({"id": "", "actor": "user", "confidence": 2}, ["/id minLength", "/actor enum", "/confidence maximum"]),
    ({"actor": None, "confidence": "1"}, ["/id required", "/confidence type"]),
    ({"id": "n", "actor": None, "confidence": 1, "inferred": True}, ["/spans required"]),
    ({"id": "n", "actor": None, "confidence": 1, "inferred": False}, []),
    ({"id": "n", "actor": None, "confidence": 1, "spans": []}, ["/spans minItems"]),
    ({"id": "n", "actor": None, "confidence": 1, "spans": ["span:a", "x", "span:", 3]}, ["/spans maxItems", "/spans/1 pattern", "/spans/1 minLength", "/spans/2 pattern", "/spans/2 minLength", "/spans/3 type"]),
    ({"id": "n", "actor": None, "confidence": 1, "spans": ["span:a", "span:a"]}, ["/spans uniqueItems"]),
    ({"id": "n", "actor": None, "confidence": 1, "other": 1, "note": None}, ["/other additionalProperties"]),
    ({"id": "n", "actor": None, "confidence": 1, "note": "123456", "count": 1.5}, ["/note maxLength", "/count type"]),
    ({"id": "n", "actor": None, "confidence": 1, "note": 5, "count": 0}, ["/note type", "/count exclusiveMinimum"]),
    ({"id": "n", "actor": None, "confidence": 1, "count": 2.0}, []),
    ([], [" type"]), ("text", [" type"]), (None, [" type"]), (3, [" type"]),
]


def run(spark, schema, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [[f"{x['path']} {x['keyword']}" for x in r[1]] for r in sorted(frame.select("i", schemas.failures(schema, F.col("t"))).collect())]


def test_a_schema_of_records(spark):
    got = run(spark, NORM, [json.dumps(x) for x, _ in CASES])
    for (value, want), have in zip(CASES, got, strict=True):
        assert sorted(have) == sorted(want), value


def test_what_is_no_json(spark):
    assert run(spark, NORM, ["{", None, ""]) == [[" json"]] * 3


@pytest.mark.parametrize(("schema", "good", "bad"), [
    (True, [1, None], []), (False, [], [1, None]), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["a", 3, None], [2]),
    ({"oneOf": [{"type": "number"}, {"type": "integer"}]}, [1.5], [1, "a"]), ({"not": {"type": "string"}}, [1, []], ["a"]),
    ({"const": {"a": [1, {"b": None}]}}, [{"a": [1, {"b": None}]}, {"a": [1.0, {"b": None}]}], [{"a": [1, {}]}, {"a": [1, {"b": None}], "c": 1}]), ({"enum": [1, "1", True, [1]]}, [1, "1", True, [1], 1.0], [False, "a", [2], None]),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "number"}}, [["a", 1], [], ["a"]], [[1], ["a", "b"]]), ({"contains": {"const": 3}}, [[1, 3], "x"], [[], [1]]),
    ({"additionalProperties": {"type": "string"}, "properties": {"k": {}}}, [{"k": 1, "x": "s"}], [{"x": 1}]), ({"multipleOf": 0.5}, [1, 1.5, "x"], [1.25]),
    ({"dependentRequired": {"a": ["b"]}}, [{"b": 1}, {"a": 1, "b": 1}], [{"a": 1}]), ({"minProperties": 2}, [{"a": 1, "b": None}], [{"a": 1}]),
    ({"properties": {"it's \"b\\": {"type": "null"}}}, [{"it's \"b\\": None}, {}], [{"it's \"b\\": 1}]), ({"if": {"type": "string"}, "else": {"minimum": 2}}, ["", 2], [1]), ({"maximum": 3, "exclusiveMaximum": 3}, [2.9], [3]),
])
def test_keywords(spark, schema, good, bad):
    got = run(spark, schema, [json.dumps(x) for x in good + bad])
    assert [bool(x) for x in got] == [False] * len(good) + [True] * len(bad)


def test_unknown_and_endless_schemas_are_refused():
    for schema in ({"unevaluatedItems": False}, {"$ref": "other.json"}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}):
        with pytest.raises((ValueError, KeyError)):
            schemas._Compiler(schema).failures(schema, F.lit(None), F.lit(""))


def test_invalid_rows_are_dropped_and_counted(spark):
    frame = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(CASES[:7])], "i int, t string")
    valid, counts = schemas.split_valid(frame, "t", NORM)
    assert sorted(x["i"] for x in valid.collect()) == [0, 4] and {(x["path"], x["keyword"]): x["n"] for x in counts.collect()}[("/spans/*", "pattern")] == 2
    got = frame.select(schemas.envelope(schemas.failures(NORM, F.col("t"))).alias("e")).select("e.*").collect()
    assert tuple(got[0]) == ("ok", None, 0) and got[2]["detail"] == "/id: required" and got[2]["status"] == "invalid_input"
