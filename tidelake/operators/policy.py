"""Policies: table patterns, first-match rules, layered settings with their provenance."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode_name(name: Column) -> Column:
    """One part of a table's name, so that joined names cannot be confused."""
    return F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def render_name(parts: Column) -> Column:
    """A table's name from its parts (catalog, namespace, table)."""
    return F.array_join(F.transform(parts, encode_name), "/")


def pattern_regex(pattern: str) -> str:
    """The anchored regular expression of a table pattern over rendered names. A dot parts names (backslash-dot is a
    dot), * and ? stay within a part, ** crosses parts, [..] and {a,b} are sets and alternatives."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and pattern[i + 1 : i + 2] == ".":
            out.append(r"\.")
            i += 2
            continue
        if c == "*":
            double = pattern[i + 1 : i + 2] == "*"
            out.append(".*" if double else "[^/]*")
            i += 2 if double else 1
            continue
        if c == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i)
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]")
            i = end + 1
            continue
        if c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"?": "[^/]", ".": "/", "/": "%2F", "%": "%25"}.get(c) or re.escape(c))
        i += 1
    return f"^{''.join(out)}$"


def first_match(tables: DataFrame, rules: Sequence[tuple[str, str]], name: str = "name") -> DataFrame:
    """tables with `rule` (index of the first matching pattern) and `decision`: that rule's, or "unmatched". Rules are
    configuration, a short list, and become one expression."""
    index, decision = F.lit(None).cast("int"), F.lit("unmatched")
    for i, (pattern, action) in reversed(list(enumerate(rules))):
        hit = F.col(name).rlike(pattern_regex(pattern))
        index, decision = F.when(hit, F.lit(i)).otherwise(index), F.when(hit, F.lit(action)).otherwise(decision)
    return tables.withColumns({"rule": index, "decision": decision})


def shadowed(rules: Sequence[str]) -> list[tuple[int, int]]:
    """(rule, earlier rule that leaves nothing for it): the same pattern, or a literal prefix and then **."""
    found = []
    for i, p in enumerate(rules):
        for j, q in enumerate(rules[:i]):
            prefix = q[:-2]
            if q == p or (q.endswith("**") and not re.search(r"[*?\[{\\]", prefix) and p.startswith(prefix)):
                found.append((i, j))
                break
    return found


def resolve(settings: Mapping[str, Column], names: Sequence[str]) -> tuple[Column, Column]:
    """(value, layer) of a setting from its layers in order of precedence: the first that has a value."""
    value = F.coalesce(*[settings[n] for n in names])
    layer = F.lit(None).cast("string")
    for n in reversed(names):
        layer = F.when(settings[n].isNotNull(), F.lit(n)).otherwise(layer)
    return value, layer
