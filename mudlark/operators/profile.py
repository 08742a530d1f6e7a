"""Profiles of text columns: counts, distinct values, extremes, the commonest values and shapes, in one pass of shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mudlark.functions.text import shape, utrim

DISTINCT, SHAPES, TOP = 10_000, 64, 5


def stacked(df: DataFrame, columns: list[str], na_words: tuple[str, ...] = (), row: str | None = None) -> DataFrame:
    """(pos, column, value, _row): a row a cell, trimmed; empty cells and words for missing values are null."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), utrim(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns])
    out = df.select(F.col(row).alias("_row") if row else F.lit(0).cast("long").alias("_row"), F.posexplode(cells).alias("pos", "cell"))
    value = F.col("cell.value")
    gone = (value == "") | F.lower(value).isin([w.lower() for w in na_words]) if na_words else value == ""
    return out.select("pos", F.col("cell.column").alias("column"), F.when(~gone, value).alias("value"), "_row")


def counts(cells: DataFrame) -> DataFrame:
    """Per column: non_empty, empty, distinct, min and max. Values are counted before columns are, so no column is one task."""
    by_value = cells.groupBy("pos", "column", "value").agg(F.count("*").alias("n"))
    return by_value.groupBy("pos", "column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_empty"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("empty"),
        F.count("value").alias("distinct"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def top(cells: DataFrame, most: int = TOP) -> DataFrame:
    """The commonest values of each column; ties by value."""
    by_value = cells.filter("value is not null").groupBy("pos", "column", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("pos").orderBy(F.col("n").desc(), "value")
    return by_value.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def shapes(cells: DataFrame, most: int = SHAPES) -> DataFrame:
    """The commonest shapes of each column, with the first value that has it; the rest as ``(other)``.

    Only ranks up to ``most`` are asked for, so each task keeps that many a column; the rest is what is left of the column's number.
    """
    found = cells.filter("value is not null").withColumn("shape", shape(F.col("value")))
    found = found.groupBy("pos", "column", "shape").agg(F.count("*").alias("n"), F.min(F.struct("_row", "value")).alias("first"))
    order = Window.partitionBy("pos").orderBy(F.col("n").desc(), "shape")
    listed = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    listed = listed.select("pos", "column", "shape", "n", F.col("first.value").alias("example"))
    whole = cells.filter("value is not null").groupBy("pos", "column").agg(F.count("*").alias("whole"))
    other = listed.groupBy("pos").agg(F.sum("n").alias("listed")).join(whole, "pos").withColumn("n", F.col("whole") - F.col("listed")).filter("n > 0")
    return listed.unionByName(other.select("pos", "column", F.lit("(other)").alias("shape"), "n", F.lit(None).cast("string").alias("example")))


def report(df: DataFrame, columns: list[str], na_words: tuple[str, ...] = (), row: str | None = None, head: int | None = None) -> dict:
    """A profile as plain data: columns and their few listed values, at the driver."""
    if head is not None and row is not None:
        df = df.filter(F.col(row) <= head)
    cells = stacked(df, columns, na_words, row)
    out: dict = {"complete": head is None, "columns": {c: {"non_empty": 0, "empty": 0, "distinct": 0, "min": None, "max": None, "top": [], "shapes": []} for c in columns}}
    for r in counts(cells).collect():
        many = r["distinct"] > DISTINCT
        out["columns"][r["column"]] |= {"non_empty": r["non_empty"], "empty": r["empty"], "distinct": f"at least {DISTINCT}" if many else r["distinct"], "min": r["min"], "max": r["max"]}
    for r in top(cells).orderBy("pos", "rank").collect():
        if not isinstance(out["columns"][r["column"]]["distinct"], str):
            out["columns"][r["column"]]["top"].append([r["value"], r["n"]])
    for r in shapes(cells).orderBy("pos", F.col("shape") == "(other)", F.col("n").desc(), "shape").collect():
        out["columns"][r["column"]]["shapes"].append([r["shape"], r["n"], r["example"]])
    return out
