"""Tables stacked in one file: runs of rows between blank rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 3


@dataclass(frozen=True)
class Region:
    start: int
    end: int
    rows: int


def islands(lines: DataFrame) -> DataFrame:
    """(_member, _row, blank) -> start, end (half open, from 0) and rows of each run of rows that aren't blank."""
    over = Window.partitionBy("_member").orderBy("_row")
    marked = lines.withColumn("_run", F.sum(F.col("blank").cast("int")).over(over)).filter(~F.col("blank"))
    return marked.groupBy("_member", "_run").agg((F.min("_row") - 1).alias("start"), F.max("_row").alias("end"), F.count("*").alias("rows")).drop("_run")


def regions_of(blanks: list[bool], least: int = LEAST) -> tuple[list[Region], list[Region]]:
    """(tables, dropped runs) of a file's rows. One run alone is the whole file and no region."""
    runs, start = [], None
    for i, empty in enumerate([*blanks, True]):
        if not empty and start is None:
            start = i
        elif empty and start is not None:
            runs.append(Region(start, i, i - start))
            start = None
    kept = [r for r in runs if r.rows >= least]
    if len(runs) < 2:
        return [], []
    return kept, [r for r in runs if r.rows < least]


def data_like(rows: list[list[str]], width: int) -> bool:
    """Whether a dropped run could hold data: a row with two fields or more, or a first row as wide as the table."""
    return any(sum(bool(c.strip()) for c in r) >= 2 for r in rows) or bool(rows and len(rows[0]) == width)


def adopt_header(run: list[list[str]], block: list[list[str]]) -> list[str] | None:
    """The last row of the run above a block that has no header of its own, if it is as wide as the block."""
    from mudlark.plans.sniff import header_verdict

    if not run or not block or len(run[-1]) != len(block[0]) or header_verdict(block[0], block[1:]) == "present":
        return None
    return run[-1] if header_verdict(run[-1], block) == "present" else None
