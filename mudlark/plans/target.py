"""A declared target: one CREATE TABLE with the columns that a pile of files must give, and how to find them."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from mudlark.functions.text import sanitize
from mudlark.spec import ColumnSpec
from mudlark.sqlscan import tokens

COLUMN_OPTIONS = ("matches", "if_missing", "round", "year_pivot", "epoch", "pointer")
TABLE_OPTIONS = ("files", "exclude", "match", "date_order", "verify", "timezone", "decimal_separator", "provenance", "plans")


class TargetError(ValueError):
    """A target that promises what isn't enforced."""


@dataclass(frozen=True)
class TargetColumn:
    name: str
    dtype: str
    precision: int = 38
    scale: int = 0
    nullable: bool = True
    matches: tuple[str, ...] = ()
    if_missing: str | None = None
    round: str | None = None
    year_pivot: int | None = None
    epoch: str | None = None
    pointer: str | None = None

    def spec(self, **more) -> ColumnSpec:
        return ColumnSpec(name=self.name, dtype=self.dtype, nullable=self.nullable, **({"precision": self.precision, "scale": self.scale} if self.dtype == "decimal" else {}), **more)


@dataclass(frozen=True)
class Target:
    name: str
    columns: tuple[TargetColumn, ...]
    files: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    match: str | None = None
    date_order: str | None = None
    verify: str = "full"
    timezone: str | None = None
    decimal_separator: str | None = None
    provenance: bool = False
    plans: str = "sidecars"
    path: str = field(default="", compare=False)

    def meaning(self) -> str:
        """A hash of what the target says; its layout, comments and place don't count."""
        data = {k: v for k, v in asdict(self).items() if k != "path" and v not in ((), None, False)}
        return "b2:" + hashlib.blake2b(json.dumps(data, sort_keys=True).encode(), digest_size=32).hexdigest()


class Parser:
    def __init__(self, sql: str):
        self.t = tokens(sql)
        self.i = 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1].lower() if self.i + k < len(self.t) else ""

    def take(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TargetError(f"expected {word!r}, found {self.peek() or 'the end'!r}")

    def next(self, *kinds: str) -> str:
        if self.i >= len(self.t) or self.t[self.i][0] not in kinds:
            raise TargetError(f"expected a {' or '.join(kinds)}, found {self.peek() or 'the end'!r}")
        text = self.t[self.i][1]
        self.i += 1
        return text

    def name(self) -> str:
        text = self.next("word", "name")
        return text[1:-1].replace('""', '"') if text[0] in "\"`" else text.lower()

    def text(self) -> str:
        return self.next("text")[1:-1].replace("''", "'")

    def number(self) -> int:
        digits = ""
        while re.fullmatch(r"\d", self.peek()):
            digits += self.next("mark")
        if not digits:
            raise TargetError(f"expected a number, found {self.peek()!r}")
        return int(digits)

    def options(self, known: tuple[str, ...]) -> dict[str, str | list[str]]:
        self.need("(")
        out: dict[str, str | list[str]] = {}
        while not self.take(")"):
            key = self.name()
            if key not in known:
                raise TargetError(f"unknown option {key!r}; there are {', '.join(known)}")
            if key in out:
                raise TargetError(f"option {key!r} is given twice")
            self.take("=")
            if self.take("("):
                values = [self.text()]
                while self.take(","):
                    values.append(self.text())
                self.need(")")
                out[key] = values
            elif self.take("["):
                values = [self.text()]
                while self.take(","):
                    values.append(self.text())
                self.need("]")
                out[key] = values
            else:
                out[key] = self.text()
            if not self.take(",") and self.peek() != ")":
                raise TargetError(f"expected , or ), found {self.peek()!r}")
        return out


def listed(v: str | list[str] | None) -> tuple[str, ...]:
    return () if v is None else tuple(v) if isinstance(v, list) else tuple(x.strip() for x in v.split(",") if x.strip())


def column_type(p: Parser) -> dict:
    kind = p.name()
    if kind in ("text", "string", "varchar", "char"):
        if p.peek() == "(":
            raise TargetError(f"{kind}(n): lengths aren't enforced; write TEXT")
        return {"dtype": "utf8"}
    if kind in ("boolean", "bool"):
        return {"dtype": "bool"}
    if kind == "bigint":
        return {"dtype": "int64"}
    if kind == "double":
        p.take("precision")
        return {"dtype": "float64"}
    if kind in ("decimal", "numeric"):
        if not p.take("("):
            raise TargetError("DECIMAL needs a precision")
        precision, scale = p.number(), 0
        if p.take(","):
            scale = p.number()
        p.need(")")
        if not (1 <= precision <= 38 and scale <= precision):
            raise TargetError(f"impossible DECIMAL({precision},{scale})")
        return {"dtype": "decimal", "precision": precision, "scale": scale}
    if kind == "date":
        return {"dtype": "date"}
    if kind == "timestamp":
        if p.take("("):
            if p.number() != 6:
                raise TargetError("TIMESTAMP keeps microseconds: write TIMESTAMP or TIMESTAMP(6)")
            p.need(")")
        zoned = p.take("with", "time", "zone")
        p.take("without", "time", "zone")
        return {"dtype": "timestamp", "zoned": zoned}
    raise TargetError(f"type {kind.upper()} isn't enforced; there are TEXT, BOOLEAN, BIGINT, DOUBLE, DECIMAL(p,s), DATE, TIMESTAMP")


def parse(sql: str, path: str = "") -> Target:
    p = Parser(sql)
    for word in ("create", "table"):
        p.need(word)
    if p.take("if"):
        raise TargetError("IF NOT EXISTS has no meaning here")
    name = p.name()
    if p.peek() in ("as", "like"):
        raise TargetError("a target lists its columns")
    p.need("(")
    columns: list[TargetColumn] = []
    zoned = False
    while True:
        if p.peek() in ("primary", "unique", "foreign", "check", "constraint"):
            raise TargetError(f"{p.peek().upper()} isn't enforced")
        column = p.name()
        kind = column_type(p)
        zoned = zoned or kind.pop("zoned", False)
        more: dict = {}
        while p.peek() not in (",", ")"):
            if p.take("not", "null"):
                more["nullable"] = False
            elif p.take("null"):
                more["nullable"] = True
            elif p.take("options"):
                o = p.options(COLUMN_OPTIONS)
                more |= {"matches": listed(o.get("matches"))} if "matches" in o else {}
                more |= {k: o[k] for k in ("if_missing", "round", "epoch", "pointer") if k in o}
                if "year_pivot" in o:
                    more["year_pivot"] = int(o["year_pivot"])
            else:
                raise TargetError(f"{column}: {p.peek().upper() or 'the end'} isn't understood")
        if more.get("if_missing") not in (None, "null"):
            raise TargetError(f"{column}: if_missing can be 'null'")
        if more.get("if_missing") == "null" and more.get("nullable") is False:
            raise TargetError(f"{column}: NOT NULL can't be filled with null")
        if more.get("round") not in (None, "half_away", "error"):
            raise TargetError(f"{column}: round can be 'half_away' or 'error'")
        columns.append(TargetColumn(column, **kind, **more))
        if p.take(")"):
            break
        p.need(",")
    repeats = {c.name for c in columns if sum(d.name == c.name for d in columns) > 1}
    if repeats:
        raise TargetError(f"column {sorted(repeats)[0]!r} is declared twice")
    o = p.options(TABLE_OPTIONS) if p.take("with") else {}
    p.take(";")
    if p.i < len(p.t):
        raise TargetError("a target is one CREATE TABLE and nothing more")
    if zoned != ("timezone" in o):
        raise TargetError("TIMESTAMP WITH TIME ZONE and timezone go together")
    if o.get("date_order") not in (None, "dmy", "mdy", "ymd"):
        raise TargetError("date_order can be dmy, mdy or ymd")
    plain = {k: o[k] for k in ("match", "date_order", "verify", "timezone", "decimal_separator", "plans") if k in o}
    return Target(name, tuple(columns), listed(o.get("files")), listed(o.get("exclude")), provenance=str(o.get("provenance", "false")).lower() == "true", path=path, **plain)


def load(path: str) -> Target:
    return parse(Path(path).read_text(), path)


def norm(name: str) -> str:
    """A header for comparison: no case, white space or punctuation, but the percent sign."""
    return re.sub(r"[\s()\[\]_\-.,:;]+", "", name.casefold())


def bind(column: TargetColumn, headers: list[str]) -> list[str]:
    """The headers that a column goes by: its own name, then each alias; exact, then alike, then as a clean name."""
    for wanted in (column.name, *column.matches):
        for same in (lambda a, b: a == b, lambda a, b: norm(a) == norm(b), lambda a, b: sanitize(a) == sanitize(b)):
            hits = [h for h in headers if same(wanted, h)]
            if hits:
                return hits
    return []
