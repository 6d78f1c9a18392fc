import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenweir.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, calls array<struct<id: string, name: string, arguments: string>>, answers string, level string, kind string"
TOOLS = {"find": {"properties": {"q": "string", "n": "integer", "x": "number", "o": "object", "l": "array", "b": "boolean", "z": "null"}, "required": ["q"]}, "stop": {}}


def run(spark, rows):
    rows = [(*r, "clash", "clash") for r in rows]
    out = C.linked(spark.createDataFrame(rows, SCHEMA), TOOLS)
    return out.orderBy("conv_id", "ready", "level", "turn", "line").collect()


def test_links_chains_and_cycles(spark):
    rows = [
        (1, 0, "user", "go", None, None),
        (1, 1, "assistant", None, [("a", "find", '{"q": "x"}'), ("b", "find", '{"q": "$ref:a"}')], None),
        (1, 2, "tool", "rb", None, "b"),
        (1, 3, "tool", "ra", None, "a"),
        (1, 4, "assistant", None, [("c", "stop", "{}"), ("d", "find", '{"q":"$ref:e"}'), ("e", "find", '{"q":"$ref:d"}'), ("a", "stop", "{}"), (None, "stop", "{}")], None),
        (1, 5, "tool", "?", None, "nobody"),
        (1, 6, "tool", "late", None, "a"),
        (2, 0, "tool", "early", None, "s"),
        (2, 1, "assistant", "hm", [("s", "stop", "{}")], None),
        (None, 0, "assistant", "", [("s", "stop", "{}")], None),
        (None, 1, "tool", None, None, "s"),
    ]
    got = {(r.conv_id, r.turn, r.kind, r.call_id): r for r in run(spark, rows)}
    assert len(got) == 16
    a, b = got[1, 1, "call", "a"], got[1, 1, "call", "b"]
    assert (a.linked, a.peer_turn, a.level, a.ready) == (True, 3, 0, 1) and (b.linked, b.peer_turn, b.level, b.ready) == (True, 2, 2, 3)
    assert (got[1, 2, "result", "b"].level, got[1, 2, "result", "b"].ready) == (3, 3)
    assert got[1, 4, "call", "d"].level is None and got[1, 4, "call", "e"].level is None
    assert got[1, 4, "call", "a"].problems == ["identifier already used"] and not got[1, 4, "call", "a"].linked
    assert got[1, 4, "call", None].problems == ["no identifier"]
    assert not got[1, 6, "result", "a"].linked and not got[1, 5, "result", "nobody"].linked
    early = got[2, 0, "result", "s"]
    assert (early.linked, early.ready, early.level) == (True, 1, 1)
    assert got[None, 1, "result", "s"].linked
    assert json.loads(a.line) == {"content": None, "role": "assistant", "tool_call": {"arguments": {"q": "x"}, "id": "a", "name": "find"}}


@pytest.mark.parametrize(
    ("arguments", "want"),
    [
        ('{"q":"a","n":3,"x":1.5,"o":{},"l":[1],"b":true,"z":null}', []),
        ('{"q":1,"n":"3","x":"1","o":[],"l":{},"b":0,"z":0}', ["b is no boolean", "l is no array", "n is no integer", "o is no object", "q is no string", "x is no number", "z is no null"]),
        ('{"n":1.5,"m":1}', ["missing q", "n is no integer", "unknown m"]),
        ('{"q":"a","q":"b"}', ["no JSON object"]),
        ("[1]", ["no JSON object"]),
        ("nope", ["no JSON object"]),
        ('{"q":"a"}}', ["no JSON object"]),
        ('{"q":"a"} {"q":"b"}', ["no JSON object"]),
        (None, ["no JSON object"]),
    ],
)
def test_arguments_against_schemas(spark, arguments, want):
    (r,) = run(spark, [(1, 0, "assistant", "t", [("i", "find", arguments)], None)])
    assert r.problems == want
    json.loads(r.line)


def test_canonical_json(spark):
    text = 'quote " back \\ line \n tab \t é 😀 \x01 /'
    (r,) = run(spark, [(1, 0, "assistant", text, [("i", "other", '{ "b" : [1, {"d":1, "c":2}], "a": "é" }')], None)])
    assert json.loads(r.line)["content"] == text
    assert '"arguments":{"a":"é","b":[1,{"c":2,"d":1}]}' in r.line and r.problems == ["unknown tool"]


def test_empty_and_repeated(spark):
    assert run(spark, []) == []
    row = (1, 0, "user", "x", None, None)
    assert len(run(spark, [row, row])) == 2


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    rel = con.sql(C.SQL["op8_tool_linking"])
    got = C.op8_tool_linking(spark, d)
    assert sorted(map(repr, map(tuple, got.select(*rel.columns).collect()))) == sorted(map(repr, rel.fetchall()))
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())
    assert got.filter("kind = 'call' AND linked").count() > 100
    assert {r[0] for r in got.filter("problems <> ''").select("problems").distinct().collect()} >= {"missing text", "turn is no integer"}
    assert {r[0] for r in got.filter("kind <> 'plain'").select("level").distinct().collect()} >= {0, 1, 2, 3}
