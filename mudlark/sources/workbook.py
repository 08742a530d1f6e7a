"""Sheets of xlsx, xlsm and ods files as rows of text, read with the standard library."""

from __future__ import annotations

import re
import zipfile
from datetime import datetime, timedelta
from typing import BinaryIO
from xml.etree import ElementTree as ET

from mudlark.sources.bytes import SourceError

M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
O = {"t": "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "o": "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}", "x": "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"}
MAX_CELLS, MAX_UNPACKED, MAX_RATIO = 50_000_000, 2 << 30, 1000
#: The number formats of the file format itself that show dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
MONEY_FORMATS = {5, 6, 7, 8, 37, 38, 39, 40, 41, 42, 43, 44}


def number_of(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def reference(ref: str) -> tuple[int, int]:
    """Row and column, from 0, of a reference such as B3."""
    m = re.fullmatch(r"\$?([A-Z]{1,3})\$?(\d+)", ref)
    if not m:
        raise SourceError(f"not a cell reference: {ref!r}")
    return int(m[2]) - 1, number_of(m[1]) - 1


def guard(z: zipfile.ZipFile) -> None:
    """Refuses archives whose declared sizes are beyond bounds, before anything is unpacked."""
    total = sum(i.file_size for i in z.infolist())
    packed = sum(i.compress_size for i in z.infolist()) or 1
    if total > MAX_UNPACKED or (total > 64 << 20 and total / packed > MAX_RATIO):
        raise SourceError(f"the workbook unpacks to {total} bytes")


def decimal_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def serial(x: float) -> str:
    """An Excel day number as ISO text; midnight has no time."""
    at = datetime(1899, 12, 30) + timedelta(milliseconds=round(x * 86_400_000))
    return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%Y-%m-%d %H:%M:%S")


class Xlsx:
    def __init__(self, f: BinaryIO):
        self.z = zipfile.ZipFile(f)
        guard(self.z)
        book = ET.fromstring(self.z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.z.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = [(s.get("name"), "xl/" + rels[s.get(f"{R}id")].removeprefix("/xl/")) for s in book.iter(f"{M}sheet")]
        self.shared = []
        if "xl/sharedStrings.xml" in self.z.namelist():
            self.shared = ["".join(t.text or "" for t in si.iter(f"{M}t")) for si in ET.fromstring(self.z.read("xl/sharedStrings.xml")).iter(f"{M}si")]
        self.formats: list[tuple[int, str]] = []
        if "xl/styles.xml" in self.z.namelist():
            styles = ET.fromstring(self.z.read("xl/styles.xml"))
            codes = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter(f"{M}numFmt")}
            xfs = styles.find(f"{M}cellXfs")
            self.formats = [(k := int(x.get("numFmtId", 0)), codes.get(k, "")) for x in (xfs if xfs is not None else [])]

    def kind(self, style: int) -> str:
        number, code = self.formats[style] if style < len(self.formats) else (0, "")
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
        if number in DATE_FORMATS or re.search(r"[ymdhs]", bare.lower()) and not re.search(r"[0#]", bare):
            return "date"
        return "money" if number in MONEY_FORMATS or re.search(r"[$€£¥]|CHF|EUR|USD", code) else "number"

    def names(self) -> list[str]:
        return [n for n, _ in self.sheets]

    def rows(self, sheet: int) -> list[list[str]]:
        return self._grid(sheet)[0]

    def money_columns(self, sheet: int) -> set[int]:
        """Columns of which four fifths of the numbers are formatted as money."""
        counts = self._grid(sheet)[1]
        return {c for c, (money, n) in counts.items() if n and money / n >= 0.8}

    def _grid(self, sheet: int) -> tuple[list[list[str]], dict[int, tuple[int, int]]]:
        raw = self.z.open(self.sheets[sheet][1])
        rows: list[list[str]] = []
        counts: dict[int, tuple[int, int]] = {}
        cells = 0
        row_at = -1
        for _, e in ET.iterparse(raw):
            if e.tag == f"{M}dimension" and ":" in e.get("ref", ""):
                a, b = (reference(x) for x in e.get("ref").split(":"))
                if (b[0] - a[0] + 1) * (b[1] - a[1] + 1) > MAX_CELLS:
                    raise SourceError("the sheet declares more cells than allowed")
            if e.tag != f"{M}row":
                continue
            row_at = int(e.get("r", row_at + 2)) - 1
            if row_at * max(1, len(e)) > MAX_CELLS:
                raise SourceError("the sheet has more rows than allowed")
            while len(rows) <= row_at:
                rows.append([])
            column = -1
            for c in e:
                column = reference(c.get("r"))[1] if c.get("r") else column + 1
                out = rows[row_at]
                out += [""] * (column + 1 - len(out))
                cells += 1
                kind, value = c.get("t", "n"), c.findtext(f"{M}v")
                if kind == "s" and value is not None:
                    out[column] = self.shared[int(value)]
                elif kind == "inlineStr":
                    out[column] = "".join(t.text or "" for t in c.iter(f"{M}t"))
                elif kind == "b":
                    out[column] = "true" if value == "1" else "false"
                elif kind == "e":
                    out[column] = f"#ERR:{value}"
                elif kind in ("str", "d"):
                    out[column] = value or ""
                elif value is not None:
                    how = self.kind(int(c.get("s", 0)))
                    out[column] = serial(float(value)) if how == "date" else decimal_text(float(value))
                    money, n = counts.get(column, (0, 0))
                    counts[column] = (money + (how == "money"), n + 1)
            e.clear()
            if cells > MAX_CELLS:
                raise SourceError("the sheet has more cells than allowed")
        return trimmed(rows), counts


class Ods:
    def __init__(self, f: BinaryIO):
        self.z = zipfile.ZipFile(f)
        guard(self.z)
        self.tables = list(ET.fromstring(self.z.read("content.xml")).iter(f"{O['t']}table"))

    def names(self) -> list[str]:
        return [t.get(f"{O['t']}name") for t in self.tables]

    def money_columns(self, sheet: int) -> set[int]:
        seen: dict[int, list[bool]] = {}
        for row in self.tables[sheet].iter(f"{O['t']}table-row"):
            for i, c in enumerate(row):
                kind = c.get(f"{O['o']}value-type")
                if kind in ("float", "currency"):
                    seen.setdefault(i, []).append(kind == "currency")
        return {i for i, x in seen.items() if sum(x) / len(x) >= 0.8}

    def rows(self, sheet: int) -> list[list[str]]:
        rows: list[list[str]] = []
        for r in self.tables[sheet].iter(f"{O['t']}table-row"):
            cells: list[str] = []
            for c in r:
                times = int(c.get(f"{O['t']}number-columns-repeated", 1))
                text = self.cell(c)
                if text or times < 1000:
                    cells += [text] * times
                if len(cells) > MAX_CELLS:
                    raise SourceError("the sheet declares more cells than allowed")
            while cells and not cells[-1]:
                cells.pop()
            times = int(r.get(f"{O['t']}number-rows-repeated", 1))
            if cells and times * len(cells) > MAX_CELLS:
                raise SourceError("the sheet declares more cells than allowed")
            rows += [list(cells) for _ in range(times if cells or times < 1000 else 1)]
        return trimmed(rows)

    def cell(self, c: ET.Element) -> str:
        kind = c.get(f"{O['o']}value-type")
        if kind in ("float", "currency", "percentage"):
            return decimal_text(float(c.get(f"{O['o']}value")))
        if kind == "date":
            return c.get(f"{O['o']}date-value").replace("T00:00:00", "").replace("T", " ")
        if kind == "boolean":
            return c.get(f"{O['o']}boolean-value")
        return "\n".join("".join(p.itertext()) for p in c.iter(f"{O['x']}p"))


def trimmed(rows: list[list[str]]) -> list[list[str]]:
    """Without blank rows at the end, and from the first used row and column."""
    while rows and not any(x.strip() for x in rows[-1]):
        rows.pop()
    used = [i for i, r in enumerate(rows) if any(r)]
    if not used:
        return []
    left = min(next(i for i, x in enumerate(r) if x) for r in rows if any(r))
    width = max(len(r) for r in rows)
    return [(r + [""] * (width - len(r)))[left:] for r in rows[used[0] :]]


def open_book(f: BinaryIO, name: str) -> Xlsx | Ods:
    low = name.lower()
    if low.endswith((".xls", ".xlsb")):
        raise SourceError(f"{name}: this workbook format isn't read; save it as xlsx")
    return Ods(f) if low.endswith(".ods") else Xlsx(f)


def sheet_index(book: Xlsx | Ods, sheet: str | int | None) -> int:
    names = book.names()
    if sheet is None:
        return 0
    if isinstance(sheet, int) and sheet < len(names):
        return sheet
    if sheet in names:
        return names.index(sheet)
    raise SourceError(f"no sheet {sheet!r}; there are {', '.join(map(repr, names))}")


def clip(rows: list[list[str]], area: str | None) -> list[list[str]]:
    if not area:
        return rows
    a, b = (reference(x) for x in area.split(":"))
    return [r[a[1] : b[1] + 1] for r in rows[a[0] : b[0] + 1]]
