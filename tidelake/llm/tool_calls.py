"""Tool-call linking for chat data, in DataFrame operations only.

Calls and results meet by a hash join on their identifier. Calls are ordered topologically: a call's level is one
more than the highest level that it depends on. Chains of calls with one dependency each are followed by pointer
doubling, in as many rounds as the logarithm of their length; on what is left, each round settles the calls whose
dependencies are all settled. Calls on a cycle stay without a level. Arguments are parsed once as variants, checked against the tool's schema (nested
objects, arrays, choices and bounds included), and written as canonical JSON (keys in order, no white space).
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import staged

#: What a variant's type may be called for each JSON type; integers are looked at more closely.
TYPES = {"string": ["STRING"], "integer": ["BIGINT", "DOUBLE", "DECIMAL"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"], "null": ["VOID"]}

#: Either {field: (JSON type, whether it is required)}, or of JSON Schema: type (one name), enum, minimum, maximum, minLength,
#: maxLength, items, minItems, maxItems, properties, required, additionalProperties (true, false).
Schema = Mapping[str, Any]


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls (call_id, ...) with `result` and `result_turn` of the first result by turn, then content, and
    `n_results`. A null identifier links with nothing; calls without a result have null and 0."""
    first = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n"))
    joined = calls.join(first.hint("shuffle_hash"), "call_id", "left")
    return joined.select(*calls.columns, F.col("r.content").alias("result"), F.col("r.turn").alias("result_turn"), F.coalesce("n", F.lit(0)).cast("long").alias("n_results"))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) for calls (call_id, depends_on array): 0 without dependencies; null on or behind a cycle.
    Dependencies on unknown calls, and on a null, count as none."""
    ids = calls.where("call_id is not null").select("call_id").distinct()
    edges = calls.where("call_id is not null").select("call_id", F.explode("depends_on").alias("on")).distinct()
    edges = staged(edges.join(ids.withColumnRenamed("call_id", "on"), "on", "left_semi"), "edges")
    by = staged(edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("on").alias("to")), "dependencies")
    chains = chain_ends(by.where("n = 1").select("call_id", "to"))
    roots = ids.join(by.select("call_id"), "call_id", "left_anti").withColumn("level", F.lit(0).cast("long"))

    # calls with several dependencies, each followed to the end of its chain; what is not known yet is null
    ends = chains.where("not open").select(F.col("call_id").alias("on"), "to", "d")
    several = edges.join(by.where("n > 1").select("call_id"), "call_id", "left_semi").join(ends, "on", "left")
    waits = staged(several.select("call_id", F.coalesce("to", "on").alias("on"), (1 + F.coalesce("d", F.lit(0))).alias("w"), F.lit(None).cast("long").alias("level")), "open")
    known = settled = staged(roots, "levels")
    while not waits.isEmpty() and not settled.isEmpty():
        told = waits.join(settled.select(F.col("call_id").alias("on"), F.col("level").alias("new")), "on", "left")
        told = staged(told.select("call_id", "on", "w", F.coalesce("level", F.col("new") + F.col("w")).alias("level")), "open")
        free = told.groupBy("call_id").agg(F.bool_and(F.col("level").isNotNull()).alias("free"), F.max("level").alias("level")).where("free")
        settled = staged(free.select("call_id", "level"), "levels")
        known = known.unionByName(settled)
        waits = told.join(settled.select("call_id"), "call_id", "left_anti")
    along = ends.join(known.withColumnRenamed("call_id", "to"), "to").select(F.col("on").alias("call_id"), (F.col("level") + F.col("d")).alias("level"))
    return ids.join(known.unionByName(along), "call_id", "left").select("call_id", F.col("level").cast("int").alias("level"))


def chain_ends(pointers: DataFrame) -> DataFrame:
    """(call_id, to, d, open) for pointers (call_id, to), one per call: `to` is the first call along them without a
    pointer of its own, d steps away. Those that never end, as they lead into a cycle, are left open."""
    has = pointers.select(F.col("call_id").alias("to"), F.lit(True).alias("has"))
    found = staged(pointers.join(has, "to", "left").select("call_id", "to", F.lit(1).cast("long").alias("d"), F.coalesce("has", F.lit(False)).alias("open")), "chains")
    for _ in range(found.count().bit_length()):
        going = found.where("open")
        if going.isEmpty():
            break
        ahead = found.select(F.col("call_id").alias("to"), F.col("to").alias("far"), F.col("d").alias("more"), F.col("open").alias("goes_on"))
        jumped = going.join(ahead, "to").select("call_id", F.col("far").alias("to"), (F.col("d") + F.col("more")).alias("d"), F.col("goes_on").alias("open"))
        found = staged(found.where("not open").unionByName(jumped), "chains")
    return found


def whole_schema(schema: Schema) -> dict[str, Any]:
    """The JSON Schema of a flat one, which allows no other fields; any other schema as it is."""
    if schema and not all(isinstance(v, tuple) for v in schema.values()):
        return dict(schema)
    return {"type": "object", "properties": {f: {"type": k} for f, (k, _) in schema.items()}, "required": [f for f, (_, r) in schema.items() if r], "additionalProperties": False}


def _path(field: str) -> str:
    """The variant path of a field, whatever dots or blanks its name has."""
    if "'" not in field and "]" not in field:
        return f"$['{field}']"
    if '"' in field or "]" in field:
        raise ValueError(f"no path names the field {field}")
    return f'$["{field}"]'


def problems(value: Column, schema: Schema) -> Column:
    """The faults of a variant object under a schema, as an array of texts: in the order of its fields, unknown ones last.

    A field that is absent or null is missing. Numbers without a fraction are integers, however they are written."""
    return _faults(value, whole_schema(schema), F.lit(""))


def _faults(value: Column, schema: Mapping[str, Any], at: Column) -> Column:
    own, inner = [], []
    label = F.nullif(at, F.lit(""))
    says = lambda when, text: own.append(F.when(when, F.concat_ws(" ", label, F.lit(text))))
    kind = F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    fits = F.lit(True)
    if name := schema.get("type"):
        fits = kind.isin(TYPES[name]) & (F.coalesce(number == F.floor(number), F.lit(False)) if name == "integer" else F.lit(True))
        says(~fits, f"is not {name}")
    numeric = kind.isin(TYPES["number"])
    if "enum" in schema:
        says(~F.to_json(value).isin([json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in schema["enum"]]), "is not one of the choices")
    for word, wrong, text_of in (("minimum", lambda x: number < x, "is below"), ("maximum", lambda x: number > x, "is above")):
        if word in schema:
            says(numeric & wrong(schema[word]), f"{text_of} {schema[word]}")
    if "minLength" in schema:
        says((kind == "STRING") & (F.char_length(text) < schema["minLength"]), f"is shorter than {schema['minLength']}")
    if "maxLength" in schema:
        says((kind == "STRING") & (F.char_length(text) > schema["maxLength"]), f"is longer than {schema['maxLength']}")
    elements = F.when(kind == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))
    if "minItems" in schema:
        says(F.size(elements) < schema["minItems"], f"has fewer than {schema['minItems']} items")
    if "maxItems" in schema:
        says(F.size(elements) > schema["maxItems"], f"has more than {schema['maxItems']} items")
    if "items" in schema:
        each = F.transform(elements, lambda v, i: _faults(v, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        inner.append(F.flatten(each))
    dot = F.when(at == "", F.lit("")).otherwise(F.concat(at, F.lit(".")))
    if "properties" in schema or schema.get("type") == "object":
        fields = schema.get("properties", {})
        required = set(schema.get("required", ()))
        for field in sorted({*fields, *required}):
            v = F.try_variant_get(value, _path(field), "variant")
            missing = v.isNull() | F.is_variant_null(v)
            there = _faults(v, fields.get(field, {}), F.concat(dot, F.lit(field)))
            lacks = F.array(F.concat(F.lit("missing "), dot, F.lit(field))) if field in required else F.array().cast("array<string>")
            inner.append(F.when(kind == "OBJECT", F.when(missing, lacks).otherwise(there)))
        if schema.get("additionalProperties", True) is False:
            names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
            extra = F.array_sort(F.array_except(names, F.array(*[F.lit(f) for f in fields]).cast("array<string>")))
            inner.append(F.transform(extra, lambda f: F.concat(F.lit("unknown "), dot, f)))
    none = F.array().cast("array<string>")
    first = F.filter(F.array(*own), lambda x: x.isNotNull()) if own else none
    return F.concat(first, *[F.coalesce(x, none) for x in inner]) if inner else first


def validated(calls: DataFrame, schemas: Mapping[str, Schema]) -> DataFrame:
    """calls (name, arguments as JSON text) with `canonical` (null if it is not a JSON object) and `faults`.

    A null or malformed text, one with a key twice, and a JSON value other than an object have the fault "not an
    object"; a name without a schema has "unknown tool".
    """
    parsed = F.try_parse_json("arguments")
    rows = calls.withColumn("_v", F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed))
    faults = F.array(F.lit("unknown tool"))
    for name, schema in sorted(schemas.items()):
        faults = F.when(F.col("name") == name, problems(F.col("_v"), schema)).otherwise(faults)
    faults = F.when(F.col("_v").isNull(), F.array(F.lit("not an object"))).otherwise(faults)
    return rows.select(*calls.columns, F.to_json("_v").alias("canonical"), faults.alias("faults"))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Schema]) -> DataFrame:
    """One row per row of calls (call_id, conv_id, turn, name, arguments, depends_on), with `level`, `result_turn`,
    `n_results`, `faults`, and `json`, the canonical form of the call and its result.

    Sorting a conversation by level, then turn, gives an order in which every call follows what it depends on.
    Repeated rows stay; results without a call are not in the result; an empty table stays empty.
    """
    keyed, others = calls.where("call_id is not null"), calls.where("call_id is null")  # the latter would meet in one task
    linked = link(keyed, results).join(levels(keyed), "call_id", "left")
    unlinked = others.withColumns({"result": F.lit(None).cast("string"), "result_turn": F.lit(None).cast(linked.schema["result_turn"].dataType), "n_results": F.lit(0).cast("long"), "level": F.lit(None).cast("int")})
    rows = validated(linked.unionByName(unlinked), schemas)
    arguments = F.coalesce("canonical", F.lit("null"))
    inner = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    whole = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), inner(F.col("call_id")), F.lit(',"name":'), inner(F.col("name")), F.lit(',"result":'), inner(F.col("result")), F.lit("}"))
    return rows.select(*calls.columns, "level", "result_turn", "n_results", "faults", whole.alias("json"))
