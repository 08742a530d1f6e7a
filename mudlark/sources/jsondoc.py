"""Strict JSON with the digits kept: numbers that a double can't hold stay as they are written."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import Any

DEPTH = 128


class JsonError(ValueError):
    """A text that isn't JSON, or not where it is looked for."""


class Number(str):
    """A number by its text."""


def _constant(name: str):
    raise JsonError(f"{name} is not JSON")


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in pairs:
        out[k] = v  # a repeated key keeps its place and takes the last value
    return out


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_constant, object_pairs_hook=_object, strict=True)


def too_deep(text: str) -> bool:
    depth = most = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text):
        if m[0] in "[{":
            depth += 1
            most = max(most, depth)
        elif m[0] in "]}":
            depth -= 1
    return most > DEPTH


def parse(text: str) -> Any:
    try:
        if text.count("[") + text.count("{") > DEPTH and too_deep(text):
            raise JsonError(f"nested deeper than {DEPTH}")
        body = text.strip(" \t\r\n")
        value, end = _DECODER.raw_decode(body)
        if end != len(body):
            raise JsonError(f"text after the document at character {end}")
        return value
    except (json.JSONDecodeError, RecursionError) as e:
        raise JsonError(str(e)) from e


def plain(x: float) -> str:
    """A double as its shortest digits, without an exponent from 1e-5 up to below 1e16."""
    if x == int(x) and abs(x) < 1e16:
        return ("-" if str(x)[0] == "-" else "") + str(abs(int(x))) + ".0"
    text = repr(x)
    if "e" in text and 1e-5 <= abs(x) < 1e16:
        text = format(Decimal(text), "f")
    return text


def number(text: str) -> str:
    """A number's text: integers as written or canonical, decimals shortest if a double holds them exactly, else verbatim."""
    if re.fullmatch(r"-?\d+", text):
        return text if len(text.lstrip("-")) > 20 or text == "-0" else str(int(text)) if text != "-0" else "-0"
    x = float(text)
    if x in (float("inf"), float("-inf")) or Decimal(text) != Decimal(repr(x)):
        return text
    short = plain(x)
    return text if "e" in short and "e" not in text.lower() else short


def render(value: Any) -> str:
    """A value as compact JSON."""
    if isinstance(value, Number):
        return number(value)
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + render(v) for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(render, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def cell(value: Any) -> str | None:
    """A value as a cell: strings bare, null nothing, nested values as JSON."""
    if value is None:
        return None
    return str(value) if isinstance(value, str) and not isinstance(value, Number) else render(value)


def resolve(value: Any, pointer: str) -> Any:
    """RFC 6901."""
    for step in pointer.split("/")[1:]:
        key = step.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict) and key in value:
            value = value[key]
        elif isinstance(value, list) and re.fullmatch(r"0|[1-9]\d*", key) and int(key) < len(value):
            value = value[int(key)]
        else:
            raise JsonError(f"nothing at {pointer!r}")
    return value


def arrays(value: Any, pointer: str = "", depth: int = 0) -> list[tuple[str, list]]:
    """Arrays that could be a table, up to six levels down: not empty, all objects or all scalars."""
    out = []
    if isinstance(value, list):
        kinds = {("object" if isinstance(x, dict) else "array" if isinstance(x, list) else "scalar") for x in value}
        if len(kinds) == 1 and kinds != {"array"}:
            out.append((pointer, value))
    elif isinstance(value, dict) and depth < 6:
        for k, v in value.items():
            out += arrays(v, f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", depth + 1)
    return out


def ranked(value: Any) -> list[tuple[str, list]]:
    """Candidate arrays, the likeliest first: objects before scalars, longer, shallower."""
    return sorted(arrays(value), key=lambda x: (not isinstance(x[1][0], dict), -len(x[1]), x[0].count("/")))
