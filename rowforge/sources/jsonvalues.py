"""JSON values in Python, strictly: objects keep their order and may not repeat a name."""

from __future__ import annotations

import json
import re
from decimal import Decimal


class Pairs(list):
    """An object's (name, value) pairs in order."""


class BadJson(ValueError):
    """A line that is not one JSON object."""


def _pairs(items) -> Pairs:
    if len({name for name, _ in items}) != len(items):
        raise BadJson("an object repeats a name")
    return Pairs(items)


def _integer(token: str) -> int | float:
    value = int(token)
    return value if -(1 << 63) <= value < 1 << 63 else float(token)


def _constant(token: str):
    raise BadJson(f"{token} is not JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=_pairs, parse_int=_integer, parse_constant=_constant, strict=True)


def loads(text: str):
    try:
        value, end = _DECODER.raw_decode(text, len(text) - len(text.lstrip(" \t\r\n")))
    except RecursionError:
        raise BadJson("nested too deeply") from None
    except json.JSONDecodeError as e:
        raise BadJson(e.msg) from None
    if text[end:].strip(" \t\r\n"):
        raise BadJson("data after the value")
    return value


_QUICK = json.JSONDecoder(parse_int=_integer, parse_constant=_constant, strict=True)
_SCALARS = {type(None), bool, int, float, str}


def flat_kinds(text: str) -> tuple | None:
    """Names and types of a record without inner objects or lists; None if it may be anything else.

    A plain dict hides repeated names, but then the text has more quotes than the dict's names and strings need.
    """
    try:
        value, end = _QUICK.raw_decode(text)
    except (ValueError, RecursionError):
        return None
    if type(value) is not dict or end != len(text):
        return None
    types = tuple(map(type, value.values()))
    if not _SCALARS.issuperset(types) or text.count('"') != 2 * (len(types) + types.count(str)):
        return None
    return tuple(value), types


def record(text: str) -> Pairs:
    value = loads(text)
    if not isinstance(value, Pairs):
        raise BadJson("not an object")
    return value


def float_text(x: float, negative_zero: bool = True) -> str:
    """Fewest digits that read back; positional from 1e-6 up to 1e21, else with an exponent."""
    if x != x or x in (float("inf"), float("-inf")):
        raise BadJson("not a finite number")
    if x == 0:
        return "-0" if negative_zero and str(x)[0] == "-" else "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text = "".join(map(str, digits))
    point = len(text) + exponent
    if 1e-6 <= abs(x) < 1e21:
        if point <= 0:
            text = "0." + "0" * -point + text
        elif point >= len(text):
            text += "0" * (point - len(text))
        else:
            text = text[:point] + "." + text[point:]
    else:
        text = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{'-' if point < 1 else '+'}{abs(point - 1)}"
    return "-" * sign + text


_HTML = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"}
_UNSAFE = re.compile("[<>&  ]")


def text(value: str) -> str:
    return _UNSAFE.sub(lambda m: _HTML[m[0]], json.dumps(value, ensure_ascii=False))


def dumps(value) -> str:
    match value:
        case None:
            return "null"
        case bool():
            return "true" if value else "false"
        case int():
            return str(value)
        case float():
            return float_text(value)
        case str():
            return text(value)
        case Pairs():
            return "{" + ",".join(f"{text(k)}:{dumps(v)}" for k, v in value) + "}"
    return "[" + ",".join(map(dumps, value)) + "]"


# --- shapes: what a column of values has in common -------------------------------------------------------

#: Values of different kinds.
MIXED = "json"


def shape(value):
    match value:
        case None:
            return None
        case bool():
            return "bool"
        case int():
            return "int"
        case float():
            return "float"
        case str():
            return "str"
        case Pairs():
            return ("object", tuple((k, shape(v)) for k, v in value)) if value else MIXED
    inner = None
    for v in value:
        inner = merge(inner, shape(v))
    return ("list", inner)


def merge(a, b):
    if a == b or b is None:
        return a
    if a is None:
        return b
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0]:
        if a[0] == "list":
            inner = merge(a[1], b[1])
            return MIXED if inner == MIXED or _mixed(inner) else ("list", inner)
        if [k for k, _ in a[1]] == [k for k, _ in b[1]]:
            fields = tuple((k, merge(x, y)) for (k, x), (_, y) in zip(a[1], b[1], strict=True))
            return MIXED if any(_mixed(t) for _, t in fields) else ("object", fields)
    return MIXED


def _mixed(s) -> bool:
    """A shape below the top that differs between rows makes the whole value a JSON value."""
    return s == MIXED or isinstance(s, tuple) and (_mixed(s[1]) if s[0] == "list" else any(_mixed(t) for _, t in s[1]))


def settled(s):
    return MIXED if _mixed(s) else s


def plain(value, s):
    """A value as Arrow wants it for its column's shape."""
    if value is None:
        return None
    if s == MIXED:
        return dumps(value)
    if isinstance(s, tuple):
        if s[0] == "list":
            return [plain(v, s[1]) for v in value]
        return {k: plain(v, t) for (k, t), (_, v) in zip(s[1], value, strict=True)}
    return value
