"""Specs compiled to DataFrames, verified once and then trusted.

Catalyst prunes columns and pushes filters, so an error inside a projection is no gate: a bad cell in a column that
nobody reads would pass. So a file is first verified: one aggregation counts, for every declared column, the cells
that don't parse and keeps the first of them. Only then is it bound, and may be pruned freely.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mudlark.functions import values
from mudlark.operators import transforms
from mudlark.operators.transforms import Frame, q
from mudlark.sources import reader
from mudlark.sources.reader import MessySource, names_of
from mudlark.spec import ColumnSpec, ParseSpec

OFFENDERS = 500


class VerifyError(ValueError):
    """A file that isn't what its spec says; ``faults`` has each column's."""

    def __init__(self, message: str, faults: list[Fault] | None = None):
        super().__init__(message)
        self.faults = faults or []


@dataclass(frozen=True)
class Fault:
    column: str
    count: int
    row: int
    value: str | None
    why: str


def schema_of(spec: ParseSpec) -> T.StructType:
    """The typed table's schema, from the spec alone."""
    fields = []
    for c in spec.columns:
        meta = {"tz": c.timezone} if c.timezone else {}
        fields.append(T.StructField(c.name, values.spark_type(c), c.nullable, metadata=meta))
    return T.StructType(fields)


def scan(spark: SparkSession, members: list[tuple[str, str, ParseSpec]]) -> DataFrame:
    """(_member, _row, cells) of files given as path, name and spec: a task a file, or one a part of a large file that is alone."""
    from mudlark.session import ship

    ship(spark)
    spark.dataSource.register(MessySource)
    told = [m for p, n, s in members for m in reader.members(p, n, s.extraction, len(members) == 1)]
    return spark.read.format("mudlark_messy").option("members", json.dumps(told)).load()


def framed(spark: SparkSession, path: str, spec: ParseSpec, name: str | None = None) -> Frame:
    """The file's table as text columns, after all transforms."""
    e = spec.extraction
    rows = scan(spark, [(path, name or Path(path).name, spec)])
    source = {"path": path, "sheet": "" if e.sheet is None else str(e.sheet), "region": "" if e.region is None else f"{e.region[0]}-{e.region[1]}"}
    if e.format == "fixed_width":
        frame = transforms.fixed_width(rows.withColumn("value", F.col("cells")[0]), list(e.fields))
    elif e.format == "lines":
        frame = transforms.lines_matching(rows.withColumn("value", F.col("cells")[0]), e.pattern, e.on_no_match)
    elif e.format == "json":
        names = names_of(e, path)
        frame = Frame(rows.select("_member", "_row", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]), tuple(names))
    else:
        frame = Frame(rows, sheet=e.format == "excel")
    frame = dataclasses.replace(frame, source=source)
    if frame.names is None:
        first = next((i for i, t in enumerate(spec.transforms) if t.op not in ("skip_rows", "drop_rows_matching")), len(spec.transforms))
        frame = transforms.apply_some(frame, spec.transforms[:first])
        frame = transforms.rectangle(frame, "pad_nulls" if frame.sheet else e.ragged)
        return transforms.apply_some(frame, spec.transforms[first:], last=True)
    return transforms.apply_some(frame, spec.transforms, last=True)


#: Transforms that look at one row at a time, so that many files can go through them at once.
BY_ROW = ("constant", "split_column", "drop_rows_matching", "unpivot")


def together(spec: ParseSpec) -> bool:
    """Whether files of this spec can be framed by one scan: a header of one row, and then row by row."""
    t = spec.transforms
    headed = bool(t) and t[0].op == "promote_header" and t[0].args.get("rows", 1) == 1
    return spec.extraction.format == "delimited" and headed and all(x.op in BY_ROW for x in t[1:])


def framed_together(spark: SparkSession, members: list[tuple[str, str, ParseSpec]]) -> list[tuple[Frame, ParseSpec, list[tuple[str, str, ParseSpec]]]]:
    """Files of specs that go :func:`together` as frames of many files: one for each spec and header that occurs.

    One job over all files finds their headers and widths: a row a file and width.
    """
    rows = scan(spark, members).filter(F.size("cells") > 0)
    found = rows.groupBy("_member", F.size("cells").alias("w")).agg(F.count("*").alias("n"), F.min(F.struct("_row", "cells")).alias("first")).collect()
    by: dict[str, list] = {}
    for r in found:
        by.setdefault(r["_member"], []).append(r)
    groups: dict[tuple, list] = {}
    for m in members:
        own, policy = by.get(m[1]), m[2].extraction.ragged
        if own is None:
            raise transforms.TransformError(f"{m[1]}: the header needs 1 rows; the table has 0")
        common = max(own, key=lambda r: (r["n"], r["w"]))
        odd = min((r for r in own if r["w"] != common["w"]), key=lambda r: r["first"]["_row"], default=None)
        if odd and policy == "error":
            raise transforms.TransformError(f"{m[1]}: row {odd['first']['_row']} has {odd['w']} fields; most rows have {common['w']}")
        n = max(r["w"] for r in own) if policy == "pad_nulls" else common["w"]
        head = min((r["first"] for r in own), key=lambda x: x["_row"])
        cells = [*head["cells"], *[""] * n][:n]
        names = transforms.header_names([cells], m[2].transforms[0].args.get("join", " "))
        groups.setdefault((repr(m[2]), head["_row"], tuple(names)), []).append(m)
    out = []
    for (_, at, names), own in groups.items():
        spec = own[0][2]
        frame = transforms.named(Frame(scan(spark, own).filter(F.col("_row") > at)), list(names))
        out.append((transforms.apply_some(frame, spec.transforms[1:], last=True), spec, own))
    return out


def faulty(frame: Frame, spec: ParseSpec) -> list[str]:
    """The files of a frame that have a cell that doesn't parse: one aggregation over all of them."""
    columns = checked(frame, spec)
    bad = F.lit(False)
    for _, _, _, p in columns:
        bad = bad | p.isNotNull()
    return [r[0] for r in frame.df.filter(bad).select("_member").distinct().collect()] if columns else []


def checked(frame: Frame, spec: ParseSpec) -> list[tuple[str, Column, Column, Column]]:
    """Each column's name, raw text, value and problem."""
    frame.need([c.origin for c in spec.columns])
    return [(c.name, q(c.origin), *parsed(frame.df.sparkSession.sparkContext.applicationId, c)) for c in spec.columns]


@lru_cache(maxsize=10_000)
def parsed(application: str, c: ColumnSpec) -> tuple[Column, Column]:
    """A column's value and problem; putting such expressions together takes longer than small files take to read."""
    return values.parse(q(c.origin), c)


def any_text(c: ColumnSpec) -> bool:
    """Whether any cell will do for a column: text as it is, or missing."""
    return c.dtype == "utf8" and c.nullable and not c.pointer


def faults(frame: Frame, spec: ParseSpec) -> list[Fault]:
    """What doesn't parse, column by column: one aggregation over the whole file, map-side first.

    Rows are named by their place in the table, so the rows up to each first fault are counted, where there is one.
    """
    both = list(zip(checked(frame, spec), spec.columns, strict=True))
    if not both:
        return []
    columns = [c for c, s in both if not any_text(s)]
    texts = [c[1] for c, s in both if any_text(s)]  # they are read all the same, for a transform may stop at them
    # Problems are columns of their own below the aggregation, so each is found once a row.
    told = frame.df.select("_row", *[x for i, (_, raw, _, p) in enumerate(columns) for x in (raw.alias(f"r{i}"), p.alias(f"p{i}"))], *[raw.alias(f"t{i}") for i, raw in enumerate(texts)])
    worst = [F.struct(F.count_if(F.col(f"p{i}").isNotNull()).alias("n"), F.min(F.when(F.col(f"p{i}").isNotNull(), F.struct("_row", F.col(f"r{i}").alias("raw"), F.col(f"p{i}").alias("why")))).alias("first")).alias(f"f{i}") for i in range(len(columns))]
    got = told.agg(*worst, *[F.count(f"t{i}").alias(f"t{i}") for i in range(len(texts))]).first()
    wrong = [i for i in range(len(columns)) if got[i]["n"]]
    if not wrong:
        return []
    upto = frame.df.agg(*[F.count_if(F.col("_row") <= got[i]["first"]["_row"]).alias(f"r{i}") for i in wrong]).first()
    return [Fault(columns[i][0], got[i]["n"], upto[f"r{i}"], got[i]["first"]["raw"], got[i]["first"]["why"]) for i in wrong]


def verify(frame: Frame, spec: ParseSpec) -> None:
    found = faults(frame, spec)
    if found:
        text = "; ".join(f"row {f.row}: cannot parse {f.value!r} as {f.column}: {f.why}" + (f" ({f.count} rows)" if f.count > 1 else "") for f in found)
        raise VerifyError(text, found)


def typed(frame: Frame, spec: ParseSpec, provenance: bool = False) -> DataFrame:
    """The typed table. A cell that doesn't parse raises, should one be left after verification."""
    out = []
    for (name, raw, value, problem), c in zip(checked(frame, spec), spec.columns, strict=True):
        said = F.concat(F.lit("row "), F.col("_row").cast("string"), F.lit(": cannot parse "), F.coalesce(raw, F.lit("null")), F.lit(f" as {name}: "), problem)
        meta = {"tz": c.timezone} if c.timezone else {}
        out.append(F.when(problem.isNull(), value).otherwise(F.raise_error(said).cast(values.spark_type(c))).alias(name, metadata=meta))
    df = transforms.dense(frame.df) if provenance else frame.df
    return df.select(*(["_member", "_row"] if provenance else []), *out)


def table(spark: SparkSession, path: str, spec: ParseSpec, provenance: bool = False, name: str | None = None, trusted: bool = False) -> DataFrame:
    """A file as its typed table, verified unless it was before."""
    frame = framed(spark, path, spec.validate(), name)
    if not trusted:
        verify(frame, spec)
    return typed(frame, spec, provenance)
