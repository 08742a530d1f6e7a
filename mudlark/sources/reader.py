"""The messy source: files as rows of text cells with their row numbers; a large file is read in parts, a task each.

``mudlark_messy`` is a Spark data source. Its schema is (_member, _row, cells) for any file, so what a row holds is
known only to the spec that is compiled above it. Rows are numbered from 1 as they are read. Parts start where a read of
the whole file saw a record start, so quoted fields may span lines in them too.
"""

from __future__ import annotations

import csv
import io
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mudlark.sources import jsondoc, workbook
from mudlark.sources.bytes import SUFFIXES, SourceError, open_plain, open_text
from mudlark.spec import Extraction

BATCH_ROWS, BATCH_CELLS = 65_536, 1 << 20
#: Bytes and number of small files that one task reads one after another.
TASK_BYTES, TASK_FILES = 8 << 20, 64
#: Characters of a part of a file, and how many parts a packed file has at most, for its parts are unpacked from the start.
PART_CHARS, PACKED_PARTS = 4 << 20, 16
WORKBOOKS = (".xlsx", ".xlsm", ".xls", ".xlsb", ".ods")


def inner_suffix(path: str) -> str:
    """The suffix under a compression suffix."""
    p = Path(path)
    return (Path(p.stem).suffix if p.suffix in SUFFIXES else p.suffix).lower()


def numbered(stream: io.TextIOBase, n: int = 0, upto: float = math.inf) -> Iterator[str]:
    """Lines with their ends, at \\n, \\r\\n and \\r. Bytes that can't be decoded stop it, with the line before them."""
    while n < upto:
        try:
            line = stream.readline()
        except UnicodeDecodeError as x:
            raise SourceError(f"after line {n}: bytes {x.object[x.start : x.end][:8]!r} aren't {x.encoding}") from x
        if not line:
            return
        n += 1
        yield line


def state(e: Extraction, path: str) -> tuple:
    """A file as it is now and what its records depend on."""
    s = Path(path.removeprefix("file://")).stat()
    return path, s.st_size, s.st_mtime_ns, repr(replace(e, ragged="error"))


#: By :func:`state`: the encoding and the marks (cookie or None, lines, rows before it) of a file that was read whole; names of its JSON objects.
_MARKS: dict[tuple, tuple[str, list[tuple[int | None, int, int]]]] = {}
_NAMES: dict[tuple, tuple[list[str], bool]] = {}


class Lines:
    """A file's lines, all or a part's: from (cookie, line, row, last line) on. ``at`` counts them from the file's start.

    Whoever reads records from it says so by :meth:`mark` once a record is whole; a file read whole so leaves its marks.
    """

    def __init__(self, e: Extraction, path: str, part: tuple | None = None):
        self.key = None if part else state(e, path)
        self.text, self.encoding = open_text(path, e.encoding)
        self.at, self.chars, self.goal = 0, 0, PART_CHARS
        self.upto = part[3] if part and part[3] is not None else math.inf
        self.marks: list[tuple[int | None, int, int]] = []
        if part:
            if part[0] is None:
                for _ in numbered(self.text, 0, part[1]):
                    pass
            else:
                self.text.seek(part[0])
            self.at = part[1]

    def __iter__(self) -> Iterator[str]:
        for line in numbered(self.text, self.at, self.upto):
            self.at += 1
            self.chars += len(line)
            yield line

    def mark(self, rows: int) -> None:
        if self.chars >= self.goal:
            self.marks.append((self.text.tell() if self.text.seekable() else None, self.at, rows))
            self.goal = self.chars + PART_CHARS

    def done(self) -> None:
        if self.key:
            _MARKS[self.key] = (self.encoding, self.marks)

    def more(self) -> bool:
        """Whether a line that isn't blank follows."""
        return any(x.strip() for x in numbered(self.text, self.at))


def parts(e: Extraction, path: str) -> tuple[str, list[tuple]] | None:
    """The encoding of a large file and its parts, or None for one that a task reads whole."""
    if e.format == "excel" or (e.format == "json" and not e.lines) or Path(path.removeprefix("file://")).stat().st_size < PART_CHARS >> 4:
        return None
    key = state(e, path)
    if key not in _MARKS:
        for _ in rows_of(e, path):
            pass
    encoding, marks = _MARKS[key]
    if marks and marks[0][0] is None:
        step = -(-(len(marks) + 1) // PACKED_PARTS)
        marks = marks[step - 1 :: step]
    starts = [(None, 0, 0), *marks]
    ends = [*(m[1] for m in marks), None]
    return (encoding, [(*a, b) for a, b in zip(starts, ends, strict=True)]) if marks else None


def delimited(e: Extraction, path: str, part: tuple | None = None) -> Iterator[list[str]]:
    """Records of a delimited file. Lines that a quoted field spans, and blank ones, count in ``region``."""
    text = Lines(e, path, part)

    def lines() -> Iterator[str]:
        for line in text:
            if e.region is not None and text.at > e.region[1]:
                return
            if e.region is not None and text.at <= e.region[0]:
                continue
            if e.comment and line.startswith(e.comment):
                continue
            yield line

    csv.field_size_limit(1 << 30)
    rows = csv.reader(lines(), delimiter=e.delimiter, quotechar=e.quote, quoting=csv.QUOTE_MINIMAL if e.quote else csv.QUOTE_NONE, escapechar=e.escape, doublequote=e.escape is None or e.escape == e.quote, strict=False)
    n = 0
    try:
        for row in rows:
            if row and not (len(row) == 1 and row[0] == ""):
                n += 1
                if text.chars >= text.goal:
                    text.mark(n)
                yield row
    except csv.Error as x:
        raise SourceError(f"{path}, line {text.at}: {x}") from x
    text.done()


def objects(e: Extraction, path: str) -> tuple[list[str], bool]:
    """The columns of a file of JSON lines, from all of them, and whether they hold bare values; kept by the file's state."""
    key = state(e, path)
    if key not in _NAMES:
        names: dict[str, None] = {}
        scalars = False
        for _, value in json_lines(e, path):
            found = jsondoc.resolve(value, e.pointer) if e.pointer else value
            if not isinstance(found, dict):
                scalars = True
            elif not found.keys() <= names.keys():
                names.update(dict.fromkeys(sorted(k for k in found if k not in names)))
        if scalars and names:
            raise SourceError(f"{path}: objects and other values are mixed")
        _NAMES[key] = (["value"] if scalars else list(names), scalars)
    return _NAMES[key]


def records(e: Extraction, path: str, part: tuple | None = None, known: tuple[list[str], bool] | None = None) -> tuple[list[str], Iterator[list[str | None]]]:
    """Columns and rows of a JSON file. Absent and null are both nothing; objects add columns as they come."""
    if e.lines:
        names, scalars = known or objects(e, path)
        found = (jsondoc.resolve(v, e.pointer) if e.pointer else v for _, v in json_lines(e, path, part))
        return list(names), ([jsondoc.cell(v)] for v in found) if scalars else ([jsondoc.cell(v.get(n)) for n in names] for v in found)
    text, _ = open_text(path, e.encoding)
    value = jsondoc.resolve(jsondoc.parse(text.read()), e.pointer)
    if e.record:
        if not isinstance(value, dict):
            raise SourceError(f"{path}: no object at {e.pointer!r}")
        return list(value), iter([[jsondoc.cell(v) for v in value.values()]])
    if not isinstance(value, list):
        raise SourceError(f"{path}: no array at {e.pointer!r}")
    if all(isinstance(x, dict) for x in value):
        names = {}
        for x in value:
            names.update(dict.fromkeys(sorted(k for k in x if k not in names)))
        return list(names), ([jsondoc.cell(x.get(n)) for n in names] for x in value)
    if any(isinstance(x, dict | list) for x in value):
        raise SourceError(f"{path}: the array at {e.pointer!r} mixes objects and other values")
    return ["value"], ([jsondoc.cell(x)] for x in value)


def json_lines(e: Extraction, path: str, part: tuple | None = None) -> Iterator[tuple[int, Any]]:
    text = Lines(e, path, part)
    held: tuple[int, Exception] | None = None
    n = 0
    for line in text:
        if not line.strip():
            continue
        if held:
            break
        try:
            value = jsondoc.parse(line)
        except jsondoc.JsonError as x:
            held = (text.at, x)
            continue
        n += 1
        text.mark(n)
        yield text.at, value
    else:
        text.done()
    if held and (text.at > held[0] and line.strip() or text.more()):
        raise SourceError(f"{path}, line {held[0]}: {held[1]}")
    if held:
        raise SourceError(f"{path}: the last line, {held[0]}, is cut short or broken: {held[1]}")


def text_lines(e: Extraction, path: str, part: tuple | None = None) -> Iterator[list[str]]:
    text = Lines(e, path, part)
    for line in text:
        text.mark(text.at)
        yield [line.rstrip("\r\n")]
    text.done()


def sheet_rows(e: Extraction, path: str) -> list[list[str]]:
    with open_plain(path, workbook=True) as f:
        book = workbook.open_book(f, path.removesuffix(Path(path).suffix) if Path(path).suffix in SUFFIXES else path)
        return workbook.clip(book.rows(workbook.sheet_index(book, e.sheet)), e.range)


def rows_of(e: Extraction, path: str, part: tuple | None = None, known: tuple[list[str], bool] | None = None) -> Iterator[list[str | None]]:
    """All rows of a file or of a part of it; JSON rows follow the order of :func:`names_of`."""
    if e.format == "delimited":
        return delimited(e, path, part)
    if e.format == "excel":
        rows = sheet_rows(e, path)
        return iter(rows[e.region[0] : e.region[1]] if e.region else rows)
    if e.format == "json":
        return records(e, path, part, known)[1]
    return text_lines(e, path, part)


def names_of(e: Extraction, path: str) -> list[str] | None:
    """The columns that a format names itself, or None."""
    return records(e, path)[0] if e.format == "json" else None


@dataclass
class Member(InputPartition):
    path: str
    name: str
    extraction: dict
    part: list | None = None
    known: list | None = None


def members(path: str, name: str, e: Extraction, split: bool = True) -> list[list]:
    """A file as what :class:`Member` takes: once, or once a part if it is large and ``split``."""
    found = parts(e, path) if split else None
    known = objects(e, path) if found and e.format == "json" else None
    told = asdict(replace(e, encoding=found[0]) if found else e)
    return [[path, name, told, p, known] for p in (found[1] if found else [None])]


@dataclass
class Members(InputPartition):
    members: list[Member]


class MessyReader(DataSourceReader):
    def __init__(self, members: list[Member]):
        self.members = members

    def partitions(self) -> list[Members]:
        """Small files share a task; a part of a large one has its own."""
        out: list[Members] = []
        room = 0
        for m in self.members:
            size = TASK_BYTES if m.part else Path(m.path.removeprefix("file://")).stat().st_size
            if not out or size > room or len(out[-1].members) >= TASK_FILES:
                out.append(Members([]))
                room = TASK_BYTES
            out[-1].members.append(m)
            room -= size
        return out

    def read(self, part: Members) -> Iterator[pa.RecordBatch]:
        for member in part.members:
            yield from self.rows(member)

    def rows(self, member: Member) -> Iterator[pa.RecordBatch]:
        e = Extraction(**{k: tuple(map(tuple, v)) if k == "fields" else tuple(v) if k == "region" and v else v for k, v in member.extraction.items()})
        rows: list[list[str | None]] = []
        first, cells = member.part[2] + 1 if member.part else 1, 0

        def pack() -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([member.name] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["_member", "_row", "cells"])

        for row in rows_of(e, member.path, member.part, member.known):
            rows.append(row)
            cells += len(row)
            if len(rows) >= BATCH_ROWS or cells >= BATCH_CELLS:
                yield pack()
                first, rows, cells = first + len(rows), [], 0
        if rows:
            yield pack()


class MessySource(DataSource):
    """Option ``members``: JSON of [path, name, extraction, part, columns], one a file or part of one, of which part and columns may be left out. A part's rows come in order."""

    @classmethod
    def name(cls) -> str:
        return "mudlark_messy"

    def schema(self) -> str:
        return "_member string, _row long, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return MessyReader([Member(*m) for m in json.loads(self.options["members"])])
