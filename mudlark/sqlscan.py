"""Finds ``messy('path'[, 'hint'])`` and ``dataset('path')`` in SQL, past comments, quotes and dollar quotes."""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"""(?P<skip>--[^\n]*|/\*.*?\*/|\s+)|(?P<dollar>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)|(?P<text>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`)|(?P<word>[A-Za-z_]\w*)|(?P<mark>.)""",
    re.S | re.X,
)


@dataclass(frozen=True)
class Reference:
    function: str
    path: str
    hint: str | None
    start: int
    end: int


def tokens(sql: str) -> list[tuple[str, str, int, int]]:
    return [(m.lastgroup if m.lastgroup != "tag" else "dollar", m[0], m.start(), m.end()) for m in TOKEN.finditer(sql) if m["skip"] is None]


def references(sql: str) -> list[Reference]:
    """Every call of the two table functions. Their arguments must be literals."""
    found, t = [], tokens(sql)
    for i, (kind, text, start, _) in enumerate(t):
        if kind != "word" or text.lower() not in ("messy", "dataset") or i + 1 >= len(t) or t[i + 1][1] != "(":
            continue
        if i and t[i - 1][1] == ".":
            continue
        args, j = [], i + 2
        while j < len(t) and t[j][0] == "text":
            args.append(t[j][1][1:-1].replace("''", "'"))
            j += 1
            if j < len(t) and t[j][1] == ",":
                j += 1
            else:
                break
        if j >= len(t) or t[j][1] != ")" or not 1 <= len(args) <= (2 if text.lower() == "messy" else 1):
            raise ValueError(f"{text}() takes literal texts: a path" + (", and a hint if need be" if text.lower() == "messy" else ""))
        found.append(Reference(text.lower(), args[0], args[1] if len(args) > 1 else None, start, t[j][3]))
    return found


def rewrite(sql: str, view) -> str:
    """The SQL with every reference replaced by the name that ``view`` gives for it."""
    out, at = [], 0
    for r in references(sql):
        out += [sql[at : r.start], view(r)]
        at = r.end
    return "".join([*out, sql[at:]])
