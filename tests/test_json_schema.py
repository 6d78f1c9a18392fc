import json

import pytest
from pyspark.sql import functions as F

from lumenweir.functions import json_schema as S
from lumenweir.functions import reports as R
from lumenweir.plans.schema_queries import verdict_by_schema
from tests.test_reports import CASES as REPORTS

TREE = {"$defs": {"id": {"type": "integer", "minimum": 1}}, "properties": {"a b": {"$ref": "#/$defs/id"}, "l": {"items": {"properties": {"x": {"items": {"$ref": "#/$defs/id"}}}, "required": ["x"]}}}}
WHEN = {"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["v"]}, "else": {"maxProperties": 1}}
CASES = [
    (True, ["1", "null"], ["", "x", "1 2", '{"a":1,"a":1}', None]),
    (False, [], ["1", "null"]),
    ({"type": "integer"}, ["1", "-9223372036854775808"], ["1.0", "1e0", "12345678901234567890", '"1"', "true", "null", "[1]"]),
    ({"type": "number"}, ["1", "1.5", "1e300", "12345678901234567890"], ['"1"', "null", "true"]),
    ({"type": ["string", "null"]}, ['"x"', "null"], ["1", "{}", "[]"]),
    ({"type": "object"}, ["{}", '{"a":null}'], ["[]", "null", '"{}"']),
    ({"type": "array"}, ["[]", "[null]"], ["{}", '"[]"']),
    ({"const": 1}, ["1", "1.0", "1e0"], ["2", '"1"', "true", "1.5"]),
    ({"const": 0.5}, ["0.5", "5e-1"], ["1", "0", "null"]),
    ({"const": True}, ["true"], ["false", "1", '"true"']),
    ({"const": {"a": [1, {"b": None}]}}, ['{"a":[1,{"b":null}]}'], ['{"a":[1,{"b":0}]}', '{"a":[1,{}]}', '{"a":[1,{"b":null}],"c":1}', '{"a":[1]}', "[]"]),
    ({"enum": ["a", None, 3]}, ['"a"', "null", "3"], ['"b"', "4", "[]"]),
    ({"enum": ["a", "b"]}, ['"a"', '"b"'], ["1", "null", '"A"']),
    ({"minLength": 2, "maxLength": 3}, ['"ab"', '"éüñ"', "1", "null", '"😀😀"'], ['"a"', '"abcd"']),
    ({"pattern": "b+"}, ['"abc"', "7"], ['"ac"', '""']),
    ({"minimum": 2, "maximum": 4.5}, ["2", "4.5", "4", '"x"'], ["1", "1.99", "5", "4.51"]),
    ({"exclusiveMinimum": 2, "exclusiveMaximum": 4}, ["3", "2.01", "3.99"], ["2", "4", "2.0", "4e0"]),
    ({"minimum": 0.5}, ["1", "0.5"], ["0", "0.4"]),
    ({"maximum": 9223372036854775806}, ["9223372036854775806"], ["9223372036854775807"]),
    ({"required": ["a", "it's"]}, ['{"a":null,"it\'s":1}', "3"], ['{"a":1}', "{}"]),
    ({"properties": {"a": False}}, ["{}", '{"b":1}'], ['{"a":1}']),
    ({"properties": {"a": {}}, "additionalProperties": False}, ["{}", '{"a":1}'], ['{"b":1}', '{"a":1,"b":1}']),
    ({"additionalProperties": {"type": "integer"}}, ["{}", '{"b":1}'], ['{"b":1,"c":"x"}']),
    ({"minProperties": 1, "maxProperties": 2}, ['{"a":1}', '{"a":1,"b":2}'], ["{}", '{"a":1,"b":2,"c":3}']),
    ({"items": {"type": "integer"}}, ["[]", "[1,2]", "{}"], ['[1,"2"]', "[null]"]),
    ({"prefixItems": [{"type": "string"}, {"const": 2}], "items": {"type": "null"}}, ["[]", '["a"]', '["a",2]', '["a",2,null]'], ["[1]", '["a",3]', '["a",2,3]']),
    ({"minItems": 1, "maxItems": 2}, ["[1]", "[1,2]", "{}"], ["[]", "[1,2,3]"]),
    ({"uniqueItems": True}, ["[]", '[1,"1",null]', '[{"a":1},{"a":2}]'], ["[1,1]", '[{"a":1,"b":2},{"b":2,"a":1}]', "[null,null]"]),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, ["2"], ["0", "4"]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5, "type": "number"}]}, ['"x"', "5"], ["4", "null"]),
    ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, ["0", "4"], ["2", "null"]),
    ({"not": {"type": "null"}}, ["0"], ["null"]),
    (WHEN, ['{"k":1,"v":2}', '{"k":2}', "7"], ['{"k":1}', '{"k":2,"v":1}']),
    (TREE, ['{"a b":1,"l":[{"x":[1,2]},{"x":[]}]}', "{}", '{"l":[5]}'], ['{"a b":0}', '{"l":[{"x":[1,0]}]}', '{"l":[{"x":[1]},{}]}']),
]


@pytest.mark.parametrize("part", range(4))
def test_keywords(spark, part):
    mine = CASES[part::4]
    rows = [(i, raw, want) for i, (_, good, bad) in enumerate(mine) for raws, want in ((good, True), (bad, False)) for raw in raws]
    df = spark.createDataFrame(rows, "i int, raw string, want boolean")
    got = df.select("*", F.array(*(S.valid_json(F.col("raw"), s) for s, _, _ in mine)).alias("got")).collect()
    assert [(mine[r.i][0], r.raw) for r in got if r.got[r.i] != r.want] == []


def test_reports_by_their_schema_have_the_same_verdicts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(REPORTS)], "i int, raw string")
    got = {r.i: r for r in df.select("i", *(verdict_by_schema(F.col("raw"), F.lit(10), o).alias(o) for o in R.ORDERS), *(R.verdict_of(F.col("raw"), F.lit(10), o).alias(f"w_{o}") for o in R.ORDERS)).collect()}
    for i, (_, want) in enumerate(REPORTS):
        assert got[i].analysis_first == want
        assert (got[i].analysis_first, got[i].verdict_first) == (got[i].w_analysis_first, got[i].w_verdict_first)


def test_answers_by_their_schema(spark):
    good = {"status": "OK", "report": json.loads(REPORTS[0][0]), "reason_code": None}
    raws = [good, good | {"status": "ok"}, good | {"report": {}}, good | {"reason_code": "INSUFFICIENT_CONTEXT"}, good | {"more": 1}, {"status": "OK", "report": None}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)], "i int, raw string")
    got = {r.i: r.v for r in df.select("i", S.valid_json(F.col("raw"), R.answer_schema()).alias("v")).collect()}
    assert [got[i] for i in range(len(raws))] == [True, False, False, True, False, False]


@pytest.mark.parametrize("schema", [{"contains": {}}, {"multipleOf": 2}, {"type": "text"}, {"$ref": "http://x"}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}, {"properties": {"a": {"patternProperties": {}}}}])
def test_what_cannot_be_compiled_is_an_error(spark, schema):
    with pytest.raises(ValueError):
        S.valid_json(F.col("raw"), schema)


def test_stale():
    schema = R.report_schema()
    assert not S.stale(S.schema_text(schema), schema)
    assert not S.stale(json.dumps(schema), schema)
    assert S.stale(S.schema_text(schema), R.report_schema("verdict_first"))
    assert S.stale(S.schema_text(schema | {"title": "t"}), schema)
    assert S.stale(None, schema) and S.stale("", schema) and S.stale("{", schema)


def test_members_are_found_by_their_own_case_and_taken_once(spark):
    schema = {"type": "object", "properties": {"a": {"type": "integer", "minimum": 2}, "a.b": {"type": "string"}, "c`d": {"type": ["null", "array"]}}, "required": ["a"], "additionalProperties": False}
    both = {"type": "object", "properties": {"a": {"type": "integer"}, "A": {"type": "string"}}, "additionalProperties": False, "anyOf": [{"required": ["a"]}, {"required": ["A"]}]}
    cases = [
        (schema, ['{"a": 2}', '{"a": 2, "a.b": "x", "c`d": null}', '{"a": 2, "c`d": [1]}'], ['{"A": 2}', '{"a": 1}', '{"a": {"x": 2}}', '{"a": 2, "A": 2}', '{"a": null}', '{"a": 2, "a.b": []}', '{"a": 2, "c`d": {}}', "[2]", "2", "{}"]),
        (both, ['{"a": 1}', '{"A": "x"}', '{"a": 1, "A": "x"}'], ['{"a": "x"}', '{"A": 1}', "{}", "[]"]),
        ({"additionalProperties": False}, ["{}", "[1]", "1"], ['{"a": 1}']),
        ({"anyOf": [{"minItems": 2}, {"type": "object"}]}, ["[1, 2]", "{}", "1"], ["[1]"]),
    ]
    for s, good, bad in cases:
        rows = spark.createDataFrame([(r,) for r in good + bad], "r string")
        assert [r.v for r in rows.select(S.valid_json(F.col("r"), s).alias("v")).collect()] == [True] * len(good) + [False] * len(bad)
    text = S.valid_json(F.col("r"), schema)._jc.toString()
    assert text.count("parse_json") == 3 and text.count("variant_get(") < 20
