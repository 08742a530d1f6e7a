"""The parsing spec: how one messy file becomes a typed table. Extraction, then transforms in order, then columns."""

from __future__ import annotations

import dataclasses
import json
import re
import tomllib
from dataclasses import dataclass, field
from typing import Any

VERSION = 1
DTYPES = ("utf8", "bool", "int64", "float64", "decimal", "date", "timestamp")
FORMATS = ("delimited", "excel", "fixed_width", "lines", "json")


class SpecError(ValueError):
    """A spec that can't mean anything."""


@dataclass(frozen=True)
class Extraction:
    """Where the cells come from. Fields that a format doesn't use stay as they are."""

    format: str = "delimited"
    encoding: str | None = None
    delimiter: str = ","
    quote: str | None = '"'
    escape: str | None = None
    comment: str | None = None
    ragged: str = "error"
    region: tuple[int, int] | None = None
    sheet: str | int | None = None
    range: str | None = None
    fields: tuple[tuple[str, int, int], ...] = ()
    pattern: str | None = None
    on_no_match: str = "skip"
    pointer: str = ""
    lines: bool = False
    record: bool = False


@dataclass(frozen=True)
class Transform:
    """One step on the cells; ``op`` names it and ``args`` holds what it takes."""

    op: str
    args: dict[str, Any] = field(default_factory=dict)


#: op -> its arguments, with defaults; ``...`` marks one that must be given.
OPS: dict[str, dict[str, Any]] = {
    "skip_rows": {"head": 0, "tail": 0},
    "promote_header": {"rows": 1, "join": " "},
    "drop_rows_matching": {"pattern": ..., "column": None},
    "fill_down": {"columns": ..., "direction": "down"},
    "remove_empty": {},
    "transpose": {},
    "split_column": {"source": ..., "into": ..., "by": ..., "on_short": "error"},
    "source_name": {"name": ..., "from": "file_stem", "pattern": None},
    "constant": {"name": ..., "value": ...},
    "unpivot": {"ids": ..., "values": ..., "variable": "variable", "value": "value"},
}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    source: str | None = None
    dtype: str = "utf8"
    nullable: bool = True
    precision: int = 38
    scale: int = 0
    pointer: str | None = None
    trim: bool = True
    replace: tuple[tuple[str, str], ...] = ()
    na_values: tuple[str, ...] = ()
    strip: str | None = None
    negative: str | None = None
    thousands: str | None = None
    decimal: str | None = None
    decimal_shift: int = 0
    round: str = "half_away"
    true_values: tuple[str, ...] = ()
    false_values: tuple[str, ...] = ()
    format: str | None = None
    year_pivot: int | None = None
    epoch: str | None = None
    timezone: str | None = None

    @property
    def origin(self) -> str:
        return self.source if self.source is not None else self.name


@dataclass(frozen=True)
class ParseSpec:
    extraction: Extraction = field(default_factory=Extraction)
    transforms: tuple[Transform, ...] = ()
    columns: tuple[ColumnSpec, ...] = ()
    confidence: float = 1.0
    notes: tuple[str, ...] = ()

    def validate(self) -> ParseSpec:
        """Raises :class:`SpecError` naming the first thing that is wrong."""
        e = self.extraction
        need(e.format in FORMATS, f"unknown format {e.format!r}")
        need(e.ragged in ("error", "pad_nulls", "truncate_extra"), f"unknown ragged policy {e.ragged!r}")
        need(e.on_no_match in ("skip", "error"), f"unknown on_no_match {e.on_no_match!r}")
        if e.format == "delimited":
            need(len(e.delimiter) == 1 and e.delimiter not in "\r\n", "the delimiter must be one character and no line end")
            need(e.quote is None or (len(e.quote) == 1 and e.quote != e.delimiter), "the quote must be one character and not the delimiter")
        if e.region is not None:
            need(0 <= e.region[0] < e.region[1], "a region must hold at least one line")
        if e.format == "fixed_width":
            need(bool(e.fields), "fixed width needs fields")
            need(all(0 <= a < b for _, a, b in e.fields), "a field must end after it starts")
        if e.format == "lines":
            need(bool(e.pattern), "lines need a pattern")
            regex(e.pattern)
            need(bool(re.search(r"\(\?P?<[A-Za-z]", e.pattern)), "the pattern needs named groups")
        need(not e.pointer or e.pointer.startswith("/"), "a JSON pointer starts with /")
        framed = e.format in ("fixed_width", "lines", "json")
        headers = [i for i, t in enumerate(self.transforms) if t.op == "promote_header"]
        need(len(headers) <= 1, "promote_header can be used once")
        need(sum(t.op == "transpose" for t in self.transforms) <= 1, "transpose can be used once")
        for i, t in enumerate(self.transforms):
            need(t.op in OPS, f"unknown transform {t.op!r}")
            a = t.args
            if t.op == "transpose":
                need(not headers or i < headers[0], "transpose goes before promote_header")
            if t.op == "promote_header":
                need(1 <= a.get("rows", 1) <= 20, "promote_header takes 1 to 20 rows")
                need(not framed, "this format names its own columns")
            if t.op == "skip_rows":
                need(a.get("head", 0) >= 0 and a.get("tail", 0) >= 0, "skip_rows takes no negative counts")
            if t.op in ("drop_rows_matching",):
                regex(a["pattern"])
            if t.op == "source_name":
                need(a.get("from", "file_stem") in ("file_stem", "file_name", "path", "sheet", "region"), "source_name: unknown from")
                regex(a.get("pattern") or "x")
            if t.op == "fill_down":
                need(a.get("direction", "down") in ("down", "up"), "fill_down goes down or up")
                need(not any(u.op == "remove_empty" for u in self.transforms[i + 1 :]), "remove_empty must go before fill_down")
            if t.op == "split_column":
                need(len(a["into"]) >= 2 and len(set(a["into"])) == len(a["into"]), "split_column needs two different names or more")
                need(set(a["by"]) <= {"delimiter", "positions", "regex"} and len(a["by"]) == 1, "split_column: by one of delimiter, positions, regex")
                if "positions" in a["by"]:
                    p = a["by"]["positions"]
                    need(list(p) == sorted(set(p)) and len(p) == len(a["into"]) - 1, "positions must ascend, one fewer than names")
                if "regex" in a["by"]:
                    need(re.compile(a["by"]["regex"]).groups == len(a["into"]), "the regex needs one group a name")
            if t.op == "unpivot":
                need(bool(a["values"]) and not set(a["ids"]) & set(a["values"]), "unpivot: values must be given and apart from ids")
        names = [c.name for c in self.columns]
        need(len(set(names)) == len(names), f"a column name is used twice: {sorted({n for n in names if names.count(n) > 1})}")
        for c in self.columns:
            need(c.dtype in DTYPES, f"{c.name}: unknown type {c.dtype!r}")
            need(1 <= c.precision <= 38 and 0 <= c.scale <= c.precision, f"{c.name}: impossible decimal({c.precision},{c.scale})")
            need(-30 <= c.decimal_shift <= 30, f"{c.name}: decimal_shift goes from -30 to 30")
            number = c.dtype in ("int64", "float64", "decimal")
            need(not c.decimal_shift or number, f"{c.name}: decimal_shift is for numbers")
            need(c.decimal_shift >= 0 or c.dtype != "int64", f"{c.name}: a negative shift can't be an integer")
            need(c.negative in (None, "parentheses", "trailing_minus"), f"{c.name}: unknown negative {c.negative!r}")
            need(c.negative is None or number, f"{c.name}: negative is for numbers")
            need(c.round in ("half_away", "error"), f"{c.name}: unknown round {c.round!r}")
            need(c.round == "half_away" or c.dtype == "decimal", f"{c.name}: round is for decimals")
            need(c.thousands is None or c.thousands != (c.decimal or "."), f"{c.name}: thousands and decimal are the same")
            need(c.epoch in (None, "seconds", "millis", "micros", "excel"), f"{c.name}: unknown epoch {c.epoch!r}")
            need(c.epoch is None or c.dtype in ("date", "timestamp"), f"{c.name}: epoch is for dates")
            need(c.epoch is None or c.format is None, f"{c.name}: epoch and format exclude each other")
            need(c.year_pivot is None or (0 <= c.year_pivot <= 100 and "%y" in (c.format or "")), f"{c.name}: year_pivot needs %y and 0 to 100")
            need(c.format is None or c.dtype in ("date", "timestamp"), f"{c.name}: format is for dates")
            need(c.timezone is None or (c.dtype == "timestamp" and bool(re.fullmatch(r"[+-]\d{2}:\d{2}", c.timezone))), f"{c.name}: timezone is a fixed offset of a timestamp")
            words = {x.lower() for x in c.na_values}
            need(not words & {x.lower() for x in (*c.true_values, *c.false_values)}, f"{c.name}: a word is both missing and boolean")
            need(not {x.lower() for x in c.true_values} & {x.lower() for x in c.false_values}, f"{c.name}: a word is both true and false")
            if c.strip:
                regex(c.strip)
            if c.pointer is not None:
                need(c.pointer.startswith("/"), f"{c.name}: a JSON pointer starts with /")
        return self


def need(ok: bool, why: str) -> None:
    if not ok:
        raise SpecError(why)


def regex(pattern: str) -> None:
    from mudlark.functions.text import java_pattern

    try:
        java_pattern(pattern)
    except (re.error, ValueError) as e:
        raise SpecError(f"bad pattern {pattern!r}: {e}") from e


def _made(kind, data: dict[str, Any], where: str):
    known = {f.name: f for f in dataclasses.fields(kind)}
    need(set(data) <= set(known), f"{where}: unknown keys {sorted(set(data) - set(known))}")
    lists = {"fields", "replace", "na_values", "true_values", "false_values", "region", "notes"}
    return kind(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if k in lists and isinstance(v, list) else v for k, v in data.items()})


def from_dict(data: dict[str, Any]) -> ParseSpec:
    """A spec from plain data; unknown keys are refused at every depth."""
    need(set(data) <= {"extraction", "transforms", "columns", "confidence", "notes"}, f"unknown keys {sorted(set(data) - {'extraction', 'transforms', 'columns', 'confidence', 'notes'})}")
    steps = []
    for t in data.get("transforms", []):
        op = t.get("op")
        need(op in OPS, f"unknown transform {op!r}")
        args = {k: v for k, v in t.items() if k != "op"}
        need(set(args) <= set(OPS[op]), f"{op}: unknown keys {sorted(set(args) - set(OPS[op]))}")
        missing = [k for k, v in OPS[op].items() if v is ... and k not in args]
        need(not missing, f"{op}: needs {missing}")
        steps.append(Transform(op, {k: args.get(k, v) for k, v in OPS[op].items()}))
    columns = tuple(_made(ColumnSpec, c, f"column {c.get('name')}") for c in data.get("columns", []))
    return ParseSpec(_made(Extraction, data.get("extraction", {}), "extraction"), tuple(steps), columns, data.get("confidence", 1.0), tuple(data.get("notes", ()))).validate()


def to_dict(spec: ParseSpec) -> dict[str, Any]:
    """Plain data of a spec, without what has its default."""

    def lean(x) -> dict[str, Any]:
        out = {}
        for f in dataclasses.fields(x):
            v = getattr(x, f.name)
            default = f.default if f.default is not dataclasses.MISSING else f.default_factory() if f.default_factory is not dataclasses.MISSING else ...
            if v != default:
                out[f.name] = json.loads(json.dumps(v))
        return out

    out: dict[str, Any] = {"extraction": lean(spec.extraction) or {"format": spec.extraction.format}}
    out["transforms"] = [{"op": t.op, **{k: v for k, v in t.args.items() if v is not None}} for t in spec.transforms]
    out["columns"] = [lean(c) for c in spec.columns]
    return out | {"confidence": spec.confidence, "notes": list(spec.notes)}


def toml(data: dict[str, Any]) -> str:
    """Plain data as TOML: scalars and lists first, then tables and arrays of tables."""

    def value(v: Any) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int | float):
            return repr(v)
        if isinstance(v, str):
            return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007f")
        if isinstance(v, dict):
            return "{ " + ", ".join(f"{json.dumps(k, ensure_ascii=False)} = {value(x)}" for k, x in v.items()) + " }"
        return "[" + ", ".join(map(value, v)) + "]"

    def table(d: dict[str, Any], path: str) -> list[str]:
        plain, rest = [], []
        for k, v in d.items():
            if isinstance(v, dict) and path.count(".") < 3 and "by" != k:
                rest += ["", f"[{path}{k}]", *table(v, f"{path}{k}.")]
            elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
                for x in v:
                    rest += ["", f"[[{path}{k}]]", *table(x, f"{path}{k}.")]
            elif v is not None:
                plain.append(f"{k} = {value(v)}")
        return plain + rest

    return "\n".join(table(data, "")) + "\n"


def loads(text: str) -> ParseSpec:
    return from_dict(tomllib.loads(text))


def dumps(spec: ParseSpec) -> str:
    return toml(to_dict(spec))


def json_schema() -> dict[str, Any]:
    """The JSON Schema of a spec, from the dataclasses."""
    kinds = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "tuple": "array", "dict": "object"}

    def of(kind) -> dict[str, Any]:
        properties = {}
        for f in dataclasses.fields(kind):
            names = {kinds.get(re.match(r"\w+", p.strip())[0], "object") for p in str(f.type).split("|") if p.strip() != "None"}
            properties[f.name] = {"type": sorted(names)[0] if len(names) == 1 else sorted(names)}
        return {"type": "object", "properties": properties, "additionalProperties": False}

    out = of(ParseSpec)
    steps = [{"type": "object", "properties": {"op": {"const": op}, **dict.fromkeys(args, {})}, "required": ["op", *(k for k, v in args.items() if v is ...)], "additionalProperties": False} for op, args in OPS.items()]
    out["properties"] |= {"extraction": of(Extraction), "columns": {"type": "array", "items": of(ColumnSpec)}, "transforms": {"type": "array", "items": {"oneOf": steps}}}
    return out
