"""A bounded subset of JSON Schema for parameters: definitions and instances."""

from __future__ import annotations

import math
import re

from ..functions.canonical import is_multiple, json_key, to_json

#: What a schema may say.
TYPES = {"null", "boolean", "integer", "number", "string", "array", "object"}
COUNTS = [("minProperties", "maxProperties"), ("minItems", "maxItems"), ("minLength", "maxLength")]
NUMBERS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")
FLAGS = ("uniqueItems", "deprecated", "readOnly", "writeOnly")
LISTS = ("allOf", "anyOf", "oneOf")
PLAIN = ("type", "enum", "const", "properties", "required", "additionalProperties", "items", "not", "pattern", "title", "description", "default", "examples", "$schema", "$id", "$comment")
KEYWORDS = {*PLAIN, *LISTS, *FLAGS, *NUMBERS, *(k for pair in COUNTS for k in pair)}
DEPTH, PATTERN = 64, 1024
#: Bytes of parameters, artifacts of a plan, bytes of input.
LIMITS = {"parameter_bytes": 1 << 20, "artifacts": 10_000, "input_bytes": 10 << 30}


class SchemaError(ValueError):
    pass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise SchemaError(what)


def _is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)


def check_pattern(pattern) -> None:
    """Literals, classes, escapes, anchors and dots only: nothing that repeats,
    groups, chooses or refers back, so matching takes linear time."""
    _need(isinstance(pattern, str) and len(pattern) <= PATTERN, f"a pattern is a string of at most {PATTERN} characters")
    bare = re.sub(r"\\.", lambda m: "\\0" if m[0][1].isdigit() else "", pattern, flags=re.S)
    _need("\\0" not in bare, "a pattern may not refer back")
    bare = re.sub(r"\[[^\]]*\]", "", bare)
    _need(not re.search(r"[()|*+?{}]", bare), "a pattern may not repeat, group or choose")
    try:
        re.compile(pattern)
    except re.error as e:
        raise SchemaError("pattern is not a regular expression") from e


def define(schema, depth: int = 0) -> None:
    """Raises SchemaError unless the schema keeps to the subset."""
    _need(isinstance(schema, dict), "a schema is an object")
    _need(depth <= DEPTH, f"schemas nest at most {DEPTH} deep")
    if unknown := sorted(schema.keys() - KEYWORDS):
        raise SchemaError(f"unknown keyword {unknown[0]}")
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        _need(isinstance(kinds, list) and bool(kinds) and all(isinstance(k, str) and k in TYPES for k in kinds), "type names no JSON type")
        _need(len(set(kinds)) == len(kinds), "types must differ")
    children = []
    if "properties" in schema:
        _need(isinstance(schema["properties"], dict) and all(isinstance(k, str) for k in schema["properties"]), "properties must be an object")
        children += schema["properties"].values()
    more = schema.get("additionalProperties", True)
    _need(isinstance(more, (bool, dict)), "additionalProperties is a boolean or a schema")
    children += [more] * isinstance(more, dict) + [schema[k] for k in ("items", "not") if k in schema]
    for k in LISTS:
        if k in schema:
            _need(isinstance(schema[k], list) and bool(schema[k]), f"{k} must be an array with elements")
            children += schema[k]
    if "required" in schema:
        names = schema["required"]
        _need(isinstance(names, list) and all(isinstance(n, str) for n in names) and len(set(names)) == len(names), "required lists different names")
    if "enum" in schema:
        _need(isinstance(schema["enum"], list) and bool(schema["enum"]), "enum must be an array with elements")
        _need(len({json_key(v) for v in schema["enum"]}) == len(schema["enum"]), "enum values must differ")
    for low, high in COUNTS:
        for k in (low, high):
            v = schema.get(k, 0)
            _need(isinstance(v, int) and not isinstance(v, bool) and v >= 0, f"{k} must be an integer from 0")
        _need(high not in schema or schema.get(low, 0) <= schema[high], f"{low} exceeds {high}")
    for k in NUMBERS:
        _need(k not in schema or _is_number(schema[k]), f"{k} must be a finite number")
    _need(schema.get("multipleOf", 1) > 0, "multipleOf must be positive")
    for k in FLAGS:
        _need(isinstance(schema.get(k, True), bool), f"{k} must be a boolean")
    if "pattern" in schema:
        check_pattern(schema["pattern"])
    for child in children:
        define(child, depth + 1)


_IS = {
    "null": lambda v: v is None,
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": _is_number,
    "string": lambda v: isinstance(v, str),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value, by a schema that define() accepts; 5.0 is no
    integer."""
    out: list[str] = []

    def want(ok: bool, what: str) -> None:
        if not ok:
            out.append(f"{at}: {what}")

    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        want(any(_IS[k](value) for k in kinds), f"must be {' or '.join(kinds)}")
    if "enum" in schema:
        want(json_key(value) in {json_key(v) for v in schema["enum"]}, "is not one of the allowed values")
    if "const" in schema:
        want(json_key(value) == json_key(schema["const"]), "is not the constant")
    for k, need in (("allOf", lambda n, of: n == of), ("anyOf", lambda n, of: n > 0), ("oneOf", lambda n, of: n == 1)):
        if k in schema:
            want(need(sum(not faults(value, s, at) for s in schema[k]), len(schema[k])), f"fails {k}")
    if "not" in schema:
        want(bool(faults(value, schema["not"], at)), "matches what it must not")
    if isinstance(value, dict):
        for name in schema.get("required", []):
            want(name in value, f"lacks {name}")
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        want(schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", math.inf), "has too few or too many properties")
        for name, v in value.items():
            if name in known:
                out += faults(v, known[name], f"{at}.{name}")
            elif isinstance(more, dict):
                out += faults(v, more, f"{at}.{name}")
            else:
                want(more, f"has an unknown property {name}")
    elif isinstance(value, list):
        want(schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf), "has too few or too many items")
        want(not schema.get("uniqueItems") or len({json_key(v) for v in value}) == len(value), "has equal items")
        for i, v in enumerate(value if "items" in schema else []):
            out += faults(v, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        want(schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf), "is too short or too long")
        want("pattern" not in schema or re.search(schema["pattern"], value) is not None, "does not match the pattern")
    elif _is_number(value):
        want(value >= schema.get("minimum", -math.inf) and value <= schema.get("maximum", math.inf), "is out of bounds")
        want(value > schema.get("exclusiveMinimum", -math.inf) and value < schema.get("exclusiveMaximum", math.inf), "is out of bounds")
        want("multipleOf" not in schema or is_multiple(value, schema["multipleOf"]), "is no multiple")
    return out


def check(value, schema: dict) -> None:
    define(schema)
    if found := faults(value, schema):
        raise ValueError("; ".join(found))


def check_limits(params: dict, artifacts: int, input_bytes: int) -> None:
    """Raises if a plan is larger than LIMITS."""
    for name, n in (("parameter_bytes", len(to_json(params).encode())), ("artifacts", artifacts), ("input_bytes", input_bytes)):
        if n > LIMITS[name]:
            raise ValueError(f"{name}: {n} is over the limit of {LIMITS[name]}")
