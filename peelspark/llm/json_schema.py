"""Canonical JSON, and what a value breaks of a JSON schema, for values and schemas of any form."""

from __future__ import annotations

import json
import math
import re

import regex

_LONE = re.compile("[\ud800-\udfff]")
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Seconds that one pattern may take on one string.
PATTERN_SECONDS = 1.0


def escaped(text: str) -> str:
    """``text`` with lone surrogates, which no encoding holds, as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """Sorted keys, no spaces, characters as they are but lone surrogates."""
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(number: str) -> float:
    x = float(number)
    if math.isinf(x):
        raise ValueError("beyond the range of doubles")
    return x


def _never(constant: str) -> None:
    raise ValueError(f"{constant} isn't JSON")


def parse(text: str):
    """The value of JSON text; ValueError for NaN, Infinity, numbers beyond doubles, integers too long and values nested too deeply."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_never)
        canonical(value)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


def is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def same(x, y) -> bool:
    """Equality of JSON values: 1 is 1.0, but neither is true."""
    if isinstance(x, dict) and isinstance(y, dict):
        return x.keys() == y.keys() and all(same(v, y[k]) for k, v in x.items())
    if isinstance(x, list) and isinstance(y, list):
        return len(x) == len(y) and all(map(same, x, y))
    if is_number(x) and is_number(y):
        return x == y
    return type(x) is type(y) and x == y


def _is_a(value, kind: str) -> bool:
    if kind == "number":
        return is_number(value)
    if kind == "integer":
        return is_number(value) and (isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind])


def _referred(root, ref: str):
    """What a local reference names; None otherwise."""
    at = root
    if not ref.startswith("#"):
        return None
    for step in filter(None, ref[1:].split("/")):
        step = step.replace("~1", "/").replace("~0", "~")
        at = at.get(step) if isinstance(at, dict) else None
    return at


def problems(value, schema) -> list[str]:
    """What breaks the schema, by the path of the value.

    Known: type, enum, const, bounds, multipleOf, lengths, pattern, properties,
    required, additionalProperties, items, sizes, uniqueItems, allOf, anyOf, oneOf,
    not, local references and boolean schemas.  A keyword whose own value has a
    wrong form, or that isn't known, asks for nothing.
    """
    try:
        return [escaped(x) for x in _problems(value, schema, "$", schema)]
    except RecursionError:
        return ["$: nested too deeply"]


def _problems(value, schema, at: str, root) -> list[str]:
    if schema is False:
        return [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return []
    get, out = schema.get, []
    deeper = lambda v, s, path: _problems(v, s, path, root)
    kinds = get("type")
    kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str) and (k in _TYPES or k in ("number", "integer"))]
    if kinds and not any(_is_a(value, k) for k in kinds):
        return [f"{at}: not {'|'.join(kinds)}"]
    if isinstance(get("$ref"), str):
        out += deeper(value, _referred(root, get("$ref")), at)
    if isinstance(get("enum"), list) and not any(same(value, x) for x in get("enum")):
        out.append(f"{at}: not in enum")
    if "const" in schema and not same(value, get("const")):
        out.append(f"{at}: not the constant")
    if is_number(value):
        out += _compared(value, schema, at, (("minimum", "below minimum", lambda v, m: v < m), ("maximum", "above maximum", lambda v, m: v > m), ("exclusiveMinimum", "not above minimum", lambda v, m: v <= m), ("exclusiveMaximum", "not below maximum", lambda v, m: v >= m), ("multipleOf", "not a multiple", _no_multiple)))
    elif isinstance(value, str):
        out += _compared(len(value), schema, at, (("minLength", "too short", lambda v, m: v < m), ("maxLength", "too long", lambda v, m: v > m)))
        if isinstance(get("pattern"), str):
            try:
                if not regex.search(get("pattern"), value, timeout=PATTERN_SECONDS):
                    out.append(f"{at}: not of the pattern")
            except TimeoutError:
                out.append(f"{at}: pattern not decided")
            except (regex.error, RecursionError):
                pass
    elif isinstance(value, dict):
        out += _compared(len(value), schema, at, (("minProperties", "too few keys", lambda v, m: v < m), ("maxProperties", "too many keys", lambda v, m: v > m)))
        known = get("properties") if isinstance(get("properties"), dict) else {}
        required = get("required") if isinstance(get("required"), list) else []
        out += [f"{at}.{k}: missing" for k in required if isinstance(k, str) and k not in value]
        for k, v in value.items():
            if k in known:
                out += deeper(v, known[k], f"{at}.{k}")
            elif get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
            else:
                out += deeper(v, get("additionalProperties"), f"{at}.{k}")
    elif isinstance(value, list):
        out += _compared(len(value), schema, at, (("minItems", "too few items", lambda v, m: v < m), ("maxItems", "too many items", lambda v, m: v > m)))
        if get("uniqueItems") is True and any(same(x, y) for i, x in enumerate(value) for y in value[:i]):
            out.append(f"{at}: repeated items")
        for i, v in enumerate(value):
            out += deeper(v, get("items"), f"{at}[{i}]")
    for word, wrong, right in (("allOf", "not all of", lambda n, k: n == k), ("anyOf", "none of", lambda n, k: n > 0), ("oneOf", "not one of", lambda n, k: n == 1)):
        if isinstance(get(word), list) and get(word) and not right(sum(not deeper(value, s, at) for s in get(word)), len(get(word))):
            out.append(f"{at}: {wrong} {len(get(word))} schemas")
    if isinstance(get("not"), (dict, bool)) and not deeper(value, get("not"), at):
        out.append(f"{at}: of the excluded schema")
    return out


def _no_multiple(value, step) -> bool:
    if step <= 0:
        return False
    if isinstance(value, int) and isinstance(step, int):
        return value % step != 0
    try:
        return not float(value / step).is_integer()
    except OverflowError:
        return False


def _compared(value, schema: dict, at: str, rules) -> list[str]:
    return [f"{at}: {says}" for word, says, breaks in rules if is_number(schema.get(word)) and breaks(value, schema[word])]
