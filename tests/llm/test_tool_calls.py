"""Tool-call linking: levels against a plain recursion, schemas, canonical JSON, odd rows."""

from __future__ import annotations

import json
import random

from tidelake.llm.tool_calls import levels, linked_calls

TOOLS = {"add": {"a": ("integer", True), "note": ("string", False), "tags": ("array", False)}}


def plain_levels(depends):
    level = {}
    moved = True
    while moved:
        moved = False
        for c, on in depends.items():
            own = [d for d in on if d in depends]
            if c not in level and all(d in level for d in own):
                level[c], moved = 1 + max((level[d] for d in own), default=-1), True
    return {c: level.get(c) for c in depends}


def test_levels_equal_a_recursion(spark):
    deal = random.Random(3)
    depends = {f"c{i}": [f"c{deal.randrange(max(0, i - 6), i)}" for _ in range(deal.choice([1, 1, 1, 1, 2, 3]))] if i and i % 40 else [] for i in range(160)}
    depends |= {f"s{i}": [f"s{i - 1}"] for i in range(70)}  # the first depends on an unknown call
    depends |= {"x": ["y"], "y": ["z"], "z": ["x"], "behind": ["x"], "both": ["c5", "behind"], "self": ["self"], "none": [None], "twice": ["c3", "c3"]}
    calls = spark.createDataFrame([(c, on) for c, on in depends.items()] + [(None, ["c1"]), ("null", None)], "call_id string, depends_on array<string>")
    found = {r.call_id: r.level for r in levels(calls).collect()}
    assert found == plain_levels(depends) | {"null": 0}


def call(i, name, arguments, depends=()):
    return (i, 1, 2, name, arguments, list(depends))


def test_arguments_results_and_canonical_json(spark):
    rows = [
        call("a", "add", '{ "note" : "x\\u00e9", "a" : 1 }'), call("b", "add", '{"a": "1", "more": 2}', ["a"]), call("c", "add", "[1]"), call("d", "add", None), call("e", "other", "{}"),
        call("f", "add", '{"tags": ["p", 2], "a": null}'), call(None, None, '{"a": 1'), call("a", "add", '{"a":1,"note":"x\\u00e9"}'), call("g", "add", json.dumps({"a": 5, "note": "n" * 100_000})),
    ]
    calls = spark.createDataFrame(rows, "call_id string, conv_id long, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([("a", 9, "late"), ("a", 3, "first"), ("a", 3, "second"), (None, 1, "lost"), ("nobody", 1, "x"), ("b", 4, None)], "call_id string, turn long, content string")
    found = linked_calls(calls, results, TOOLS).collect()
    assert len(found) == len(rows)
    by = {r.call_id: r for r in found if r.call_id != "a"}
    both = [r for r in found if r.call_id == "a"]
    assert {r.json for r in both} == {'{"arguments":{"a":1,"note":"xé"},"id":"a","name":"add","result":"first"}'} and {r.n_results for r in both} == {3}
    assert by["b"].faults == ["a is not integer", "unknown more"] and by["b"].level == 1 and by["b"].n_results == 1
    assert by["c"].faults == by["d"].faults == by[None].faults == ["not an object"] and by["e"].faults == ["unknown tool"] and by["f"].faults == ["missing a"]
    assert json.loads(by["g"].json)["arguments"]["a"] == 5 and by["g"].faults == []
    assert linked_calls(calls.limit(0), results.limit(0), TOOLS).count() == 0


NESTED = {
    "go": {
        "type": "object",
        "properties": {
            "a.b": {"type": "integer", "minimum": 1, "maximum": 9},
            "mode": {"enum": ["fast", "slow", 3]},
            "at": {"type": "object", "properties": {"x": {"type": "number"}, "name": {"type": "string", "minLength": 2, "maxLength": 4}}, "required": ["x"], "additionalProperties": False},
            "tags": {"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": 2},
        },
        "required": ["a.b"],
    }
}


def test_nested_schemas(spark):
    cases = {
        '{"a.b":3}': [],
        '{"a.b":3.0,"mode":3,"more":1}': [],
        '{"a.b":3.5}': ["a.b is not integer"],
        '{"a.b":0}': ["a.b is below 1"],
        '{"a.b":10,"mode":"quick"}': ["a.b is above 9", "mode is not one of the choices"],
        '{"mode":"slow"}': ["missing a.b"],
        '{"a.b":1,"at":{"x":1.5,"name":"abc"}}': [],
        '{"a.b":1,"at":{"name":"a","y":1}}': ["at.name is shorter than 2", "missing at.x", "unknown at.y"],
        '{"a.b":1,"at":{"x":"1","name":"abcde"}}': ["at.name is longer than 4", "at.x is not number"],
        '{"a.b":1,"at":[]}': ["at is not object"],
        '{"a.b":1,"tags":["p",2]}': ["tags[1] is not string"],
        '{"a.b":1,"tags":[]}': ["tags has fewer than 1 items"],
        '{"a.b":1,"tags":["a","b","c"]}': ["tags has more than 2 items"],
        '{"a.b":1,"tags":"a"}': ["tags is not array"],
        '{"a.b":1,"a.b":1}': ["not an object"],
    }
    calls = spark.createDataFrame([call(f"c{i}", "go", text) for i, text in enumerate(cases)], "call_id string, conv_id long, turn long, name string, arguments string, depends_on array<string>")
    found = linked_calls(calls, spark.createDataFrame([], "call_id string, turn long, content string"), NESTED).collect()
    assert {r.arguments: r.faults for r in found} == cases
