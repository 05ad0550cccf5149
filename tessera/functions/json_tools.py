"""JSON: values found in prose, schema validation, and numbers that a source doesn't have."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from tessera.functions.arrow import canonical_json


def values_in(text: str) -> list[Any]:
    """All complete objects and arrays at the top level of a text; brackets inside quoted prose don't begin one."""
    out, i, decoder = [], 0, json.JSONDecoder()
    while i < len(text):
        c = text[i]
        if c in "{[":
            try:
                value, i = decoder.raw_decode(text, i)
                out.append(value)
                continue
            except ValueError:
                pass
        elif c == '"' and (m := re.compile(r'"(?:[^"\\\n]|\\.)*"').match(text, i)):
            i = m.end()
            continue
        i += 1
    return out


_KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "null": lambda v: v is None,
    "boolean": lambda v: isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}
#: The keywords that are checked.
KEYWORDS = frozenset("type enum const required properties additionalProperties items minItems maxItems uniqueItems minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum anyOf oneOf allOf not title description default $schema $id".split())


def schema_errors(value: Any, schema: dict | bool, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, keyword) of each rule that a value breaks; an unknown keyword is itself an error."""
    if isinstance(schema, bool):
        if not schema:
            yield path, "false"
        return
    yield from ((path, f"unsupported:{k}") for k in schema if k not in KEYWORDS)
    kinds = schema.get("type")
    if kinds is not None and not any(_KINDS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield path, "type"
        return
    same = lambda a, b: canonical_json(a) == canonical_json(b)
    if "const" in schema and not same(value, schema["const"]):
        yield path, "const"
    if "enum" in schema and not any(same(value, e) for e in schema["enum"]):
        yield path, "enum"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            yield path, "length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield path, "pattern"
    if _KINDS["number"](value):
        low, high, above, below = (schema.get(k) for k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"))
        if (low is not None and value < low) or (high is not None and value > high) or (above is not None and value <= above) or (below is not None and value >= below):
            yield path, "range"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            yield path, "items"
        if schema.get("uniqueItems") and len({canonical_json(v) for v in value}) < len(value):
            yield path, "uniqueItems"
        for i, v in enumerate(value):
            yield from schema_errors(v, schema.get("items", True), f"{path}[{i}]")
    if isinstance(value, dict):
        yield from ((f"{path}.{k}", "required") for k in schema.get("required", ()) if k not in value)
        known = schema.get("properties", {})
        for k, v in value.items():
            yield from schema_errors(v, known[k] if k in known else schema.get("additionalProperties", True), f"{path}.{k}")
    fits = lambda s: next(schema_errors(value, s, path), None) is None
    if "anyOf" in schema and not any(map(fits, schema["anyOf"])):
        yield path, "anyOf"
    if "oneOf" in schema and sum(map(fits, schema["oneOf"])) != 1:
        yield path, "oneOf"
    for s in schema.get("allOf", ()):
        yield from schema_errors(value, s, path)
    if "not" in schema and fits(schema["not"]):
        yield path, "not"


_NUMBER = re.compile(r"(?<![\w.])-?\d+(?:[.,]\d+)*")


def invented_numbers(value: Any, source: str, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, number) of numbers in a value that the source text doesn't have."""
    have = {n.replace(",", "").lstrip("-") for n in _NUMBER.findall(source)}

    def walk(v: Any, at: str) -> Iterator[tuple[str, str]]:
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, f"{at}.{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, f"{at}[{i}]")
        elif isinstance(v, (int, float, str)) and not isinstance(v, bool):
            for n in _NUMBER.findall(v if isinstance(v, str) else json.dumps(v)):
                if n.replace(",", "").lstrip("-") not in have:
                    yield at, n

    yield from walk(value, path)
