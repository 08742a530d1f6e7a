"""Structural transforms on rows of text cells, as DataFrame operations.

A :class:`Frame` holds rows of one file: ``_member``, ``_row`` (ascending, not always dense) and either ``cells``, an
array, or, once the header is known, one text column a name. Nothing is sorted; order lives in ``_row``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mudlark.functions.text import blank, group_number, groups, java_pattern, unique, utrim

KEYS = ["_member", "_row"]


class TransformError(ValueError):
    """A transform that doesn't fit the table it meets."""


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    names: tuple[str, ...] | None = None
    source: dict[str, str] | None = None
    sheet: bool = False

    def columns(self) -> list[str]:
        if self.names is None:
            raise TransformError("the table has no header yet")
        return list(self.names)

    def need(self, names: list[str]) -> None:
        missing = [n for n in names if n not in self.columns()]
        if missing:
            raise TransformError(f"no column {missing[0]!r}; there are {', '.join(map(repr, self.columns()))}")


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def width(df: DataFrame) -> int:
    return df.agg(F.max(F.size("cells"))).first()[0] or 0


def widths(df: DataFrame) -> list[tuple[int, int, int]]:
    """(width, rows, first row) of the rows that aren't blank, the commonest first: a few numbers."""
    rows = df.filter(F.size("cells") > 0).groupBy(F.size("cells").alias("w")).agg(F.count("*").alias("n"), F.min("_row").alias("r"))
    return [tuple(r) for r in rows.orderBy(F.col("n").desc(), F.col("w").desc()).collect()]


def rectangle(frame: Frame, policy: str = "error") -> Frame:
    """Every row as wide as the table: the widest row, or the commonest width, as the policy says."""
    found = widths(frame.df)
    if not found:
        return frame
    if policy == "error":
        odd = [x for x in found[1:]]
        if odd:
            w, _, r = min(odd, key=lambda x: x[2])
            raise TransformError(f"row {r} has {w} fields; most rows have {found[0][0]}")
    n = max(w for w, _, _ in found) if policy == "pad_nulls" else found[0][0]
    cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    return replace(frame, df=frame.df.withColumn("cells", cells))


def skip_rows(frame: Frame, head: int = 0, tail: int = 0) -> Frame:
    """Drops the first and last rows. Which rows these are is a question to the file's ends, so it is asked once."""
    df = frame.df
    if head:
        first = [r[0] for r in df.select("_row").orderBy("_row").limit(head).collect()]
        df = df.filter(F.col("_row") > (first[-1] if first else -1))
    if tail:
        last = [r[0] for r in df.select("_row").orderBy(F.col("_row").desc()).limit(tail).collect()]
        if last:
            df = df.filter(F.col("_row") < last[-1])
    return replace(frame, df=df)


def header_names(rows: list[list[str]], join: str = " ") -> list[str]:
    """Names from header rows: all but the last fill to the right, then cells are joined downwards without empty ones."""
    n = max((len(r) for r in rows), default=0)
    filled = []
    for k, row in enumerate(rows):
        cells = [c.strip() for c in row] + [""] * (n - len(row))
        if k + 1 < len(rows):
            last = ""
            cells = [(last := c) if c else last for c in cells]
        filled.append(cells)
    return unique([join.join(c for c in column if c) for column in zip(*filled, strict=True)])


def promote_header(frame: Frame, rows: int = 1, join: str = " ") -> Frame:
    head = frame.df.orderBy("_row").limit(rows).select("_row", "cells").collect()
    if len(head) < rows:
        raise TransformError(f"the header needs {rows} rows; the table has {len(head)}")
    names = header_names([list(r["cells"]) for r in head], join)
    return named(replace(frame, df=frame.df.filter(F.col("_row") > head[-1]["_row"])), names)


def named(frame: Frame, names: list[str]) -> Frame:
    """Cells as columns. Rows narrower than the header have empty ends."""
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return replace(frame, df=frame.df.select(*KEYS, *cells), names=tuple(names))


def headless(frame: Frame) -> Frame:
    return frame if frame.names is not None else named(frame, [f"col_{i + 1}" for i in range(width(frame.df))])


def cells_of(frame: Frame) -> list[Column]:
    return [q(n) for n in frame.names] if frame.names is not None else []


def drop_rows_matching(frame: Frame, pattern: str, column: str | None = None) -> Frame:
    """Drops rows in which the pattern is found: in one column, or in the cells joined by tabs."""
    if column is not None:
        frame.need([column])
        text = q(column)
    elif frame.names is None:
        text = F.array_join("cells", "\t", "")
    else:
        text = F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in cells_of(frame)])
    return replace(frame, df=frame.df.filter(~F.coalesce(text.rlike(java_pattern(pattern)), F.lit(False))))


def fill_down(frame: Frame, columns: list[str], direction: str = "down") -> Frame:
    """Blank cells take the last value above (or the next below) in their file; on sheets blank rows stay blank."""
    frame.need(columns)
    over = Window.partitionBy("_member").orderBy("_row")
    over = over.rowsBetween(Window.unboundedPreceding, 0) if direction == "down" else over.rowsBetween(0, Window.unboundedFollowing)
    pick = F.last if direction == "down" else F.first
    gap = F.lit(False)
    if frame.sheet:
        gap = F.lit(True)
        for c in cells_of(frame):
            gap = gap & blank(c)
    filled = {c: F.when(gap, q(c)).otherwise(F.coalesce(pick(F.when(~blank(q(c)), q(c)), ignorenulls=True).over(over), q(c))) for c in columns}
    return replace(frame, df=frame.df.select(*KEYS, *[filled.get(n, q(n)).alias(n) for n in frame.names]))


def remove_empty(frame: Frame) -> Frame:
    if frame.names is None:
        return replace(frame, df=frame.df.filter(F.exists("cells", lambda c: ~blank(c))))
    some = F.lit(False)
    for c in cells_of(frame):
        some = some | ~blank(c)
    return replace(frame, df=frame.df.filter(some))


def transpose(frame: Frame) -> Frame:
    """Rows become columns; short rows are padded. A table that is turned over is as wide as it had rows."""
    if frame.names is not None:
        raise TransformError("transpose goes before the header")
    each = frame.df.select("_member", "_row", F.posexplode("cells").alias("pos", "cell"))
    rows = frame.df.groupBy("_member").agg(F.sort_array(F.collect_list("_row")).alias("rows"))
    turned = each.groupBy("_member", "pos").agg(F.map_from_entries(F.collect_list(F.struct("_row", "cell"))).alias("by"))
    cells = F.transform("rows", lambda r: F.coalesce(F.element_at("by", r), F.lit("")))
    return replace(frame, df=turned.join(rows, "_member").select("_member", (F.col("pos") + 1).cast("long").alias("_row"), cells.alias("cells")))


def split_column(frame: Frame, source: str, into: list[str], by: dict, on_short: str = "error") -> Frame:
    """One column becomes several in its place, by a delimiter, character positions or the groups of a pattern."""
    frame.need([source])
    others = [n for n in frame.names if n != source]
    clash = [n for n in into if n in others]
    if clash:
        raise TransformError(f"split_column: {clash[0]!r} is a column already")
    c, n = q(source), len(into)
    if "delimiter" in by:
        parts = F.split(c, re.escape(by["delimiter"]), n)
        got = [F.get(parts, F.lit(i)) for i in range(n)]
        enough = F.size(parts) >= n
    elif "positions" in by:
        edges = [0, *by["positions"]]
        got = [utrim(F.substring(c, a + 1, (edges[i + 1] - a) if i + 1 < len(edges) else 1_000_000_000)) for i, a in enumerate(edges)]
        enough = F.length(c) > edges[-1]
        got = [F.when(F.length(c) > a, g) for a, g in zip(edges, got, strict=True)]
    else:
        pattern = java_pattern(by["regex"])
        enough = c.rlike(pattern)
        got = [F.when(enough, F.regexp_extract(c, pattern, i + 1)) for i in range(n)]
        got[0] = F.when(enough, F.regexp_extract(c, pattern, 1)).otherwise(c)
    if on_short == "error":
        fault = F.raise_error(F.concat(F.lit("row "), F.col("_row").cast("string"), F.lit(f": {source} can't be split into {n}: "), c))
        got = [F.when(c.isNull() | enough, g).otherwise(fault.cast("string")) for g in got]
    new: list[Column] = []
    names: list[str] = []
    for name in frame.names:
        new += [g.alias(i) for g, i in zip(got, into, strict=True)] if name == source else [q(name)]
        names += into if name == source else [name]
    return replace(frame, df=frame.df.select(*KEYS, *new), names=tuple(names))


def source_value(source: dict[str, str], origin: str, pattern: str | None) -> str:
    path = PurePosixPath(source.get("path", ""))
    value = {"file_stem": path.name.split(".")[0] if path.name.count(".") > 1 and path.suffix in (".gz", ".zst", ".bz2", ".xz") else path.stem, "file_name": path.name, "path": str(path)}.get(origin, source.get(origin, ""))
    if pattern is None:
        return value
    found = re.search(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern), value)
    if not found:
        raise TransformError(f"source_name: {pattern!r} isn't found in {value!r}")
    return (found[1] if found.re.groups else found[0]) or ""


def added(frame: Frame, name: str, value: Column) -> Frame:
    frame = headless(frame)
    if name in frame.names:
        raise TransformError(f"{name!r} is a column already")
    return replace(frame, df=frame.df.select(*KEYS, *cells_of(frame), value.alias(name)), names=(*frame.names, name))


def source_name(frame: Frame, name: str, pattern: str | None = None, **more) -> Frame:
    return added(frame, name, F.lit(source_value(frame.source or {}, more.get("from", "file_stem"), pattern)))


def constant(frame: Frame, name: str, value: str) -> Frame:
    return added(frame, name, F.lit(value if value != "" else None).cast("string"))


def unpivot(frame: Frame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> Frame:
    """Wide to long, row by row; empty cells stay. New rows are numbered by old row and column."""
    frame.need([*ids, *values])
    clash = [n for n in (variable, value) if n in ids]
    if clash or variable == value:
        raise TransformError(f"unpivot: {(clash or [value])[0]!r} is used twice")
    each = F.posexplode(F.array(*[F.struct(F.lit(v).alias("k"), q(v).alias("x")) for v in values])).alias("_pos", "_x")
    out = frame.df.select("_member", (F.col("_row") * len(values)).alias("_base"), *[q(i) for i in ids], each)
    out = out.select("_member", (F.col("_base") + F.col("_pos")).alias("_row"), *[q(i) for i in ids], F.col("_x.k").alias(variable), F.col("_x.x").alias(value))
    return replace(frame, df=out, names=(*ids, variable, value))


def fixed_width(lines: DataFrame, fields: list[tuple[str, int, int]]) -> Frame:
    """(_member, _row, value) lines as fields at character offsets, trimmed; blank lines go."""
    kept = lines.filter(~blank(F.col("value")))
    got = [utrim(F.substring("value", a + 1, b - a)).alias(n) for n, a, b in fields]
    return Frame(kept.select(*KEYS, *got), tuple(n for n, _, _ in fields))


def lines_matching(lines: DataFrame, pattern: str, on_no_match: str = "skip") -> Frame:
    """Lines as the named groups of a pattern; others are skipped or stop the query. Blank lines go."""
    kept = lines.filter(~blank(F.col("value")))
    java = java_pattern(pattern)
    names = groups(pattern)
    hit = F.col("value").rlike(java)
    got = [F.regexp_extract("value", java, group_number(pattern, n)) for n in names]
    if on_no_match == "skip":
        kept = kept.filter(hit)
    else:
        fault = F.raise_error(F.concat(F.lit("row "), F.col("_row").cast("string"), F.lit(": the line doesn't match: "), F.col("value"))).cast("string")
        got = [F.when(hit, g).otherwise(fault) for g in got]
    return Frame(kept.select(*KEYS, *[g.alias(n) for g, n in zip(got, names, strict=True)]), tuple(names))


def dense(df: DataFrame) -> DataFrame:
    """Rows numbered from 1 in each file."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy("_member").orderBy("_row")).cast("long"))


APPLY = {
    "skip_rows": skip_rows,
    "promote_header": promote_header,
    "drop_rows_matching": drop_rows_matching,
    "fill_down": fill_down,
    "remove_empty": remove_empty,
    "transpose": transpose,
    "split_column": split_column,
    "source_name": source_name,
    "constant": constant,
    "unpivot": unpivot,
}
#: After the last of these, sheets lose their blank rows.
FRAMING = ("skip_rows", "transpose", "promote_header", "fill_down")


def apply_some(frame: Frame, steps, last: bool = False) -> Frame:
    """Transforms in order; ``last`` says that no more follow, and gives a table without a header ``col_N``."""
    framing = [i for i, t in enumerate(steps) if t.op in FRAMING]
    for i, t in enumerate(steps):
        if frame.names is None and t.op in ("fill_down", "split_column", "unpivot", "source_name", "constant"):
            frame = headless(frame)
        frame = APPLY[t.op](frame, **t.args)
        if last and frame.sheet and framing and i == framing[-1]:
            frame = remove_empty(frame)
    if last and frame.sheet and not framing:
        frame = remove_empty(frame)
    return headless(frame) if last else frame
