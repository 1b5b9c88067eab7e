"""Doubles and JSON as the reports print them: shortest digits in Java's layout, keys in insertion order."""

from __future__ import annotations

import math
from typing import Any


def double_text(x: float) -> str:
    """The shortest decimal that reads back as x: plain from 1e-3 up to 1e7, else with an exponent."""
    x = float(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "-0.0" if math.copysign(1, x) < 0 else "0.0"
    sign, text = ("-", repr(-x)) if x < 0 else ("", repr(x))
    mantissa, _, exponent = text.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits, point = (whole + part).lstrip("0"), len(whole) + int(exponent or 0)
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    digits = digits.rstrip("0") or "0"
    if 1e-3 <= abs(x) < 1e7:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{digits}"
        padded = digits.ljust(point, "0")
        return f"{sign}{padded[:point]}.{padded[point:] or '0'}"
    return f"{sign}{digits[0]}.{digits[1:] or '0'}E{point - 1}"


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_text(value: Any) -> str:
    """Compact JSON; every number is a double, so that a count of 21 prints as 21.0. NaN and infinities are refused."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        if not math.isfinite(value):
            raise ValueError(f"{value} has no JSON form")
        return double_text(value)
    if isinstance(value, str):
        return '"' + "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in value) + '"'
    if isinstance(value, dict):
        return "{" + ",".join(f"{json_text(str(k))}:{json_text(v)}" for k, v in value.items()) + "}"
    return "[" + ",".join(map(json_text, value)) + "]"
