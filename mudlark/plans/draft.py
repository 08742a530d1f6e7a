"""Drafts a target from a pile: sniffed columns are merged by name, and types where they meet."""

from __future__ import annotations

from collections import Counter

from mudlark.functions.text import sanitize
from mudlark.plans import sniff
from mudlark.spec import ColumnSpec

LIKE = 0.5


def merge(a: ColumnSpec, b: ColumnSpec) -> tuple[str, int, int, str | None]:
    """The type that holds both, and what is lost."""
    if a.dtype == b.dtype == "decimal":
        return "decimal", max(a.precision, b.precision), max(a.scale, b.scale), None
    if a.dtype == b.dtype:
        return a.dtype, 38, 0, None
    kinds = {a.dtype, b.dtype}
    if kinds == {"int64", "float64"} or kinds == {"float64", "decimal"}:
        return "float64", 38, 0, None
    if kinds == {"int64", "decimal"}:
        d = a if a.dtype == "decimal" else b
        return "decimal", max(d.precision, 19), d.scale, None
    return "utf8", 38, 0, f"{a.dtype} in some files, {b.dtype} in others"


def sql_type(dtype: str, precision: int = 38, scale: int = 0) -> str:
    return {"utf8": "TEXT", "bool": "BOOLEAN", "int64": "BIGINT", "float64": "DOUBLE", "date": "DATE", "timestamp": "TIMESTAMP"}.get(dtype, f"DECIMAL({precision},{scale})")


def groups(vocabularies: dict[str, set[str]]) -> list[list[str]]:
    """Files whose column names overlap by half or more, largest group first."""
    out: list[tuple[set[str], list[str]]] = []
    for path, words in sorted(vocabularies.items()):
        for seen, paths in out:
            if len(seen & words) >= LIKE * len(seen | words):
                paths.append(path)
                break
        else:
            out.append((words, [path]))
    return sorted((p for _, p in out), key=lambda p: -len(p))


def draft(paths: list[str], name: str = "pile", files: str = "*") -> str:
    """A CREATE TABLE for the largest group of files that share their columns."""
    specs = {p: sniff.infer(p) for p in paths}
    kept = groups({p: {c.name for c in s.columns} for p, s in specs.items()})[0]
    columns: dict[str, ColumnSpec] = {}
    spellings: dict[str, list[str]] = {}
    caveats: dict[str, str] = {}
    seen: Counter[str] = Counter()
    for p in kept:
        for c in specs[p].columns:
            seen[c.name] += 1
            spellings.setdefault(c.name, [])
            if c.origin not in spellings[c.name]:
                spellings[c.name].append(c.origin)
            if c.name not in columns:
                columns[c.name] = c
                continue
            dtype, precision, scale, caveat = merge(columns[c.name], c)
            columns[c.name] = ColumnSpec(name=c.name, dtype=dtype, precision=precision, scale=scale)
            if caveat:
                caveats[c.name] = caveat
    lines = []
    for n, c in columns.items():
        options = []
        other = [s for s in spellings[n] if s != n]
        if other:
            options.append("matches = (" + ", ".join("'" + s.replace("'", "''") + "'" for s in other) + ")")
        if seen[n] < len(kept):
            options.append("if_missing = 'null'")
        precision = min(c.precision, 18) if c.dtype == "decimal" and c.precision == 38 else c.precision
        line = f'  "{n}" {sql_type(c.dtype, precision, c.scale)}' + (f" OPTIONS ({', '.join(options)})" if options else "")
        lines.append((line, caveats.get(n)))
    body = "\n".join(line + ("," if i + 1 < len(lines) else "") + (f"  -- {note}" if note else "") for i, (line, note) in enumerate(lines))
    left = [p for p in paths if p not in kept]
    head = "".join(f"-- left out, other columns: {p}\n" for p in left)
    return f"{head}CREATE TABLE {sanitize(name)} (\n{body}\n) WITH (files = '{files}');\n"
