"""Canonical JSON, names by content, versions and orders (driver side)."""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from collections.abc import Iterable
from fractions import Fraction

from .text import SEMVER

#: Names by content are UUIDs of this namespace.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tessera:artifact")
MAX_DEPTH = 8


def content_id(schema: str, sha256: str) -> str:
    """The same id wherever the same bytes have the same schema."""
    return str(uuid.uuid5(NAMESPACE, f"{schema}\n{sha256}"))


def to_json(value) -> str:
    """Compact JSON with sorted keys; NaN and infinities raise."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def json_key(value):
    """Hashable; equal if and only if two JSON values are: 1 and 1.0 are equal,
    1 and true aren't."""
    if value is None or isinstance(value, (bool, str)):
        return (type(value).__name__, value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and not math.isfinite(value):
            raise ValueError("JSON has no NaN or infinity")
        return ("number", Fraction(value))
    if isinstance(value, dict):
        return ("object", frozenset((k, json_key(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return ("array", tuple(json_key(v) for v in value))
    raise ValueError(f"not a JSON value: {type(value).__name__}")


def is_multiple(value, of) -> bool:
    """Exact, also for decimal fractions as they are written."""
    return (Fraction(repr(value)) / Fraction(repr(of))).denominator == 1


def dimensions(value, depth: int = MAX_DEPTH) -> list[int]:
    """Lengths of a rectangular nested array, from outside; a ragged one raises."""
    if not isinstance(value, list):
        return []
    if not depth:
        raise ValueError("arrays are nested too deep")
    inner = {tuple(dimensions(v, depth - 1)) for v in value}
    if len(inner) > 1:
        raise ValueError("array is not rectangular")
    return [len(value), *(inner.pop() if inner else ())]


def version(text: str) -> tuple:
    """Sort key of a semantic version; builds don't count."""
    if not (m := re.fullmatch(SEMVER.removeprefix(r"\A").removesuffix(r"\z"), text)):
        raise ValueError(f"not a version: {text}")
    pre = (m[4] or "").lstrip("-")
    parts = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in pre.split(".")) if pre else ()
    return (int(m[1]), int(m[2]), int(m[3]), not pre, parts)


def in_range(text: str, clauses: str) -> bool:
    """Whether a version meets all clauses, such as ">=1.2,<2"."""
    have = version(text)
    for clause in clauses.split(","):
        if not (m := re.fullmatch(r"\s*(==|>=|<=|>|<)\s*(\d+(?:\.\d+){0,2})\s*", clause)):
            raise ValueError(f"not a version clause: {clause}")
        want = version(".".join((m[2].split(".") + ["0", "0"])[:3]))
        if not {"==": have == want, ">=": have >= want, "<=": have <= want, ">": have > want, "<": have < want}[m[1]]:
            return False
    return True


def collection_digest(items: Iterable[tuple[str, str, int]]) -> tuple[str, int]:
    """(digest, bytes) of (key, sha256, size) in the order of keys, which differ."""
    rows = ascending(items)
    return hashlib.sha256(to_json([[k, d, n] for k, d, n in rows]).encode()).hexdigest(), sum(n for _, _, n in rows)


def ascending(items: Iterable[tuple]) -> list[tuple]:
    """Sorted by the first element; a repeated one raises."""
    rows = sorted(items, key=lambda r: r[0])
    if any(a[0] == b[0] for a, b in zip(rows, rows[1:])):
        raise ValueError("a key occurs twice")
    return rows


def stage_order(needs: dict[str, list[str]]) -> list[str]:
    """Stages after what they need, alphabetical where free; a cycle raises."""
    left, out = {k: set(v) for k, v in needs.items()}, []
    if unknown := set().union(*left.values(), ()) - left.keys():
        raise ValueError(f"unknown stage: {sorted(unknown)[0]}")
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise ValueError("stages form a cycle")
        out.append(ready[0])
        del left[ready[0]]
        for v in left.values():
            v.discard(ready[0])
    return out
