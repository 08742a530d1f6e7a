"""Plans a file onto a target: the sniffed frame is kept, its columns are bound and typed anew, all gaps are told."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from mudlark.functions.text import NA_WORDS
from mudlark.plans import compiler, sniff
from mudlark.plans.target import Target, TargetColumn, bind, norm
from mudlark.sources import jsondoc
from mudlark.sources.bytes import open_text
from mudlark.spec import ColumnSpec, Extraction, ParseSpec, Transform

ORDERS = {"dmy": ("%d.%m.%Y", "%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%Y/%m/%d", "%Y%m%d"), "mdy": ("%m/%d/%Y", "%Y-%m-%d", "%Y/%m/%d", "%Y%m%d"), "ymd": ("%Y-%m-%d", "%Y/%m/%d", "%Y%m%d")}


@dataclass(frozen=True)
class Gap:
    """Why a target column can't be filled."""

    kind: str  # NoCandidate, Ambiguous, Untypable, AmbiguousSeparator, AmbiguousFormat, NothingAtPointer, Collides
    column: str
    why: str


@dataclass
class Fit:
    path: str
    spec: ParseSpec | None
    gaps: list[Gap] = field(default_factory=list)
    reviews: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def date_formats(values: list[str], formats: tuple[str, ...], order: str | None) -> tuple[str | None, str | None]:
    """The format that reads all values, and another that reads one of them differently."""
    fits = [f for f in formats if all(sniff.strptime(v, f) for v in values)]
    if not fits:
        return None, None
    rivals = [f for f in fits[1:] if any(sniff.strptime(v, f) != sniff.strptime(v, fits[0]) for v in values)]
    if rivals and order:
        first = next((f for f in ORDERS[order] if f in fits), fits[0])
        return first, None
    return fits[0], rivals[0] if rivals else None


def type_for(t: TargetColumn, source: str, cells: list[str], target: Target) -> tuple[ColumnSpec | None, Gap | None, list[str]]:
    """How the cells of a source column become the declared type, or why they can't."""
    from mudlark.functions import numfmt

    raw = [c.strip() for c in cells if c is not None and c.strip()]
    words = tuple(sorted({c.lower() for c in raw if c.lower() in NA_WORDS})) if t.dtype != "utf8" else ()
    seen = [c for c in raw if c.lower() not in NA_WORDS] if t.dtype != "utf8" else raw
    out = replace(t.spec(), source=source, na_values=words, pointer=t.pointer)
    reviews: list[str] = []
    bad = lambda why: (None, Gap("Untypable", t.name, why), [])
    if t.dtype == "utf8":
        return out, None, reviews
    if t.dtype == "bool":
        odd = next((c for c in seen if c.lower() not in (*sniff.BOOLS, "1", "0")), None)
        return bad(f"{odd!r} is no boolean word") if odd else (out, None, reviews)
    if t.dtype in ("int64", "float64", "decimal"):
        if re.search(r"\b(rp|rappen|cents?|ct|tsd|k|mio)\b\.?$", norm(source) if " " not in source else source.casefold()) and t.dtype == "decimal" and t.scale and all(re.fullmatch(r"[+-]?\d+", c) for c in seen):
            return bad(f"{source!r} counts in another unit; decimal_shift in the spec says how many places")
        found = numfmt.infer(seen) if seen else numfmt.NumberFormat()
        if found is None and t.dtype == "float64" and all(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", c) for c in seen):
            return out, None, reviews
        if found is None:
            odd = next((c for c in seen if numfmt.roles(c) is None), seen[0])
            return bad(f"{odd!r} is no number, or the column mixes two ways to write them")
        if found.ambiguous:
            mark = found.thousands or found.decimal
            if not target.decimal_separator:
                return None, Gap("AmbiguousSeparator", t.name, f"{mark!r} could group digits or part them; decimal_separator settles it"), []
            found = numfmt.NumberFormat(decimal=mark, scale=3) if mark == target.decimal_separator else numfmt.NumberFormat(thousands=mark)
        if t.dtype == "int64" and found.decimal:
            return bad(f"{source!r} has decimals")
        out = replace(out, thousands=found.thousands, decimal=found.decimal if found.decimal not in (None, ".") else None)
        if t.dtype == "decimal":
            out = replace(out, round=t.round or "error")
            if (t.round or "error") == "error" and found.scale > t.scale and any(len(re.sub(r"0+$", "", c.rsplit(found.decimal, 1)[1])) > t.scale for c in seen if found.decimal and found.decimal in c):
                return bad(f"values have more than {t.scale} decimals; round = 'half_away' allows it")
        return out, None, reviews
    if t.epoch:
        reviews.append(f"{t.name}: read as epoch in {t.epoch}")
        return replace(out, epoch=t.epoch, timezone=target.timezone if t.dtype == "timestamp" else None), None, reviews if not t.epoch else []
    formats = sniff.DATES if t.dtype == "date" else (*sniff.TIMES, *sniff.DATES)
    if t.year_pivot is not None:
        formats = (*formats, "%d.%m.%y", "%d/%m/%y", "%m/%d/%y", "%y-%m-%d")
    if target.date_order:
        formats = tuple(sorted(formats, key=lambda f: next((i for i, o in enumerate(ORDERS[target.date_order]) if f.startswith(o)), 99)))
    best, rival = date_formats(seen, formats, target.date_order)
    if best is None and seen:
        return bad(f"{seen[0]!r} follows no known date format")
    if rival:
        return None, Gap("AmbiguousFormat", t.name, f"{best} and {rival} read it differently; date_order settles it"), []
    pivot = t.year_pivot if best and "%y" in best else None
    return replace(out, format=best, year_pivot=pivot, timezone=target.timezone if t.dtype == "timestamp" else None), None, reviews


def long_form(target: Target, unbound: list[TargetColumn], names: list[str], body: list[list[str | None]]) -> str | None:
    """The column whose values are the names that are missing, if two or more are there."""
    wanted = {norm(c.name) for c in unbound} | {norm(m) for c in unbound for m in c.matches}
    for i, name in enumerate(names):
        if len({norm(r[i]) for r in body if i < len(r) and r[i]} & wanted) >= 2:
            return name
    return None


def probe(spark: SparkSession, path: str, spec: ParseSpec) -> tuple[list[str], list[list[str | None]]]:
    frame = compiler.framed(spark, path, spec)
    rows = frame.df.orderBy("_row").limit(sniff.PROBE).collect()
    return list(frame.names), [[r[n] for n in frame.names] for r in rows]


def fit_frame(spark: SparkSession, path: str, target: Target, frame: ParseSpec) -> Fit:
    """Binds and types one frame; all gaps are collected before it gives up."""
    names, body = probe(spark, path, frame)
    out = Fit(path, None)
    columns: list[ColumnSpec] = []
    steps = list(frame.transforms)
    taken: dict[str, str] = {}
    unbound: list[TargetColumn] = []
    for t in target.columns:
        hits = bind(t, names)
        twins = [n for n in names if hits and re.fullmatch(re.escape(hits[0]) + r"_\d+", n, re.I)]
        if len(hits) > 1 or twins:
            out.gaps.append(Gap("Ambiguous", t.name, f"several columns go by that name: {', '.join([*hits, *twins])}"))
            continue
        if not hits:
            if t.if_missing == "null":
                steps.append(Transform("constant", {"name": f"missing_{t.name}", "value": ""}))
                columns.append(replace(t.spec(), source=f"missing_{t.name}"))
                continue
            unbound.append(t)
            continue
        if hits[0] in taken and not t.pointer:
            out.gaps.append(Gap("Collides", t.name, f"{hits[0]!r} is taken by {taken[hits[0]]}"))
            continue
        taken[hits[0]] = t.name
        i = names.index(hits[0])
        cells = [r[i] for r in body]
        if t.pointer:
            got = []
            for c in cells:
                try:
                    got.append(jsondoc.cell(jsondoc.resolve(jsondoc.parse(c), t.pointer)) if c else None)
                except jsondoc.JsonError:
                    got.append(None)
            if not any(x is not None for x in got):
                out.gaps.append(Gap("NothingAtPointer", t.name, f"nothing at {t.pointer} in {hits[0]!r}"))
                continue
            cells = got
        spec, gap, reviews = type_for(t, hits[0], cells, target)
        if gap:
            out.gaps.append(gap)
        else:
            columns.append(spec)
            out.reviews += reviews
    if unbound:
        by = long_form(target, unbound, names, body)
        for t in unbound:
            out.gaps.append(Gap("NoCandidate", t.name, f"the file has {', '.join(map(repr, names))}" + (f"; {by!r} holds such names as values: the file is in long form" if by else "")))
    if out.gaps:
        return out
    spec = replace(frame, transforms=tuple(steps), columns=tuple(columns), notes=()).validate()
    found = compiler.faults(compiler.framed(spark, path, spec), spec)
    # Words for missing values may first occur behind the rows that were looked at.
    late = {f.column for f in found if (f.value or "").strip().lower() in NA_WORDS and f.why != "a value is missing"}
    if late:
        spec = replace(spec, columns=tuple(replace(c, na_values=NA_WORDS[1:]) if c.name in late else c for c in spec.columns))
        found = compiler.faults(compiler.framed(spark, path, spec), spec)
    out.gaps = [Gap("Untypable", f.column, f"row {f.row}: {f.value!r}: {f.why} ({f.count} rows)") for f in found]
    out.spec = None if out.gaps else spec
    out.reviews += review(spec, target) if not out.gaps else []
    return out


def review(spec: ParseSpec, target: Target) -> list[str]:
    """What a person must see before the plan is used: judgements that the data can't prove."""
    declared = {c.name: c for c in target.columns}
    out = [f"{t.args['name']}: every row gets {t.args['value']!r}" for t in spec.transforms if t.op == "constant" and t.args["value"]]
    for c in spec.columns:
        if c.format and "%y" in c.format and declared[c.name].year_pivot is None:
            out.append(f"{c.name}: two-digit years")
        if c.epoch and declared[c.name].epoch is None:
            out.append(f"{c.name}: read as epoch in {c.epoch}")
        if c.decimal_shift:
            out.append(f"{c.name}: the point moves by {c.decimal_shift}")
    return out


def frames(path: str) -> list[ParseSpec]:
    """The frames that a file could be read by: every table-like array of a JSON document, every sheet, else the sniffed one."""
    first = sniff.infer(path)
    if first.extraction.format == "json" and not first.extraction.lines:
        text, _ = open_text(path, first.extraction.encoding)
        doc = jsondoc.parse(text.read())
        found = [replace(first, extraction=replace(first.extraction, pointer=p, record=False), columns=()) for p, _ in jsondoc.ranked(doc)]
        if isinstance(doc, dict):
            found.append(replace(first, extraction=replace(first.extraction, pointer="", record=True), columns=()))
        return found
    if first.extraction.format == "excel":
        from mudlark.sources.bytes import open_plain
        from mudlark.sources.workbook import open_book

        with open_plain(path, workbook=True) as f:
            names = open_book(f, path).names()
        return [sniff.infer(path, n) for n in names]
    return [first]


def plan(spark: SparkSession, path: str, target: Target) -> list[Fit]:
    """The one frame of a file that fits; none gives the best failure, several give all of them."""
    tried = [fit_frame(spark, path, target, replace(f, columns=())) for f in frames(path)]
    fits = [t for t in tried if t.spec]
    if fits:
        return fits
    return [min(tried, key=lambda t: len(t.gaps))] if tried else [Fit(path, None, [Gap("NoCandidate", c.name, "no table in the file") for c in target.columns])]


def propose(spark: SparkSession, path: str, target: Target, column: str) -> list[str]:
    """Columns that an unbound target column could mean, by type; a suggestion only."""
    t = next(c for c in target.columns if c.name == column)
    frame = replace(frames(path)[0], columns=())
    names, body = probe(spark, path, frame)
    bound = {h for c in target.columns for h in bind(c, names)}
    return [n for i, n in enumerate(names) if n not in bound and type_for(t, n, [r[i] for r in body], target)[1] is None and any(r[i] and r[i].strip() for r in body)]


def conforms(spec: ParseSpec, target: Target) -> list[str]:
    """How the spec's table differs from the declared one: names, order, types, nullability, zone, reading, pointer."""
    out = []
    have, want = [c.name for c in spec.columns], [c.name for c in target.columns]
    out += [f"{n}: missing" for n in want if n not in have] + [f"{n}: not declared" for n in have if n not in want]
    if not out and have != want:
        out.append(f"columns are in another order: {', '.join(have)}")
    made = {f.name: f for f in compiler.schema_of(spec)}
    for t in target.columns:
        if t.name not in made:
            continue
        c = next(c for c in spec.columns if c.name == t.name)
        wanted = compiler.schema_of(ParseSpec(columns=(t.spec(timezone=target.timezone if t.dtype == "timestamp" and target.timezone else None),)))[0]
        got = made[t.name]
        if got.dataType != wanted.dataType:
            out.append(f"{t.name}: {got.dataType.simpleString()} instead of {wanted.dataType.simpleString()}")
        if got.nullable != t.nullable:
            out.append(f"{t.name}: {'' if got.nullable else 'not '}nullable")
        if got.metadata.get("tz") != wanted.metadata.get("tz"):
            out.append(f"{t.name}: zone {got.metadata.get('tz')} instead of {wanted.metadata.get('tz')}")
        if c.dtype == "decimal" and c.round != (t.round or "error"):
            out.append(f"{t.name}: rounds {c.round}")
        if c.pointer != t.pointer and not c.origin.startswith("missing_"):
            out.append(f"{t.name}: pointer {c.pointer} instead of {t.pointer}")
    return out
