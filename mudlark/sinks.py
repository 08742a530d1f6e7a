"""Query results as a printed table, CSV, NDJSON or Parquet."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = {".csv": "csv", ".json": "ndjson", ".ndjson": "ndjson", ".jsonl": "ndjson", ".parquet": "parquet", ".txt": "table"}


def format_for(path: str | None, wanted: str | None = None) -> str:
    """The format asked for, or the one of the path's extension; an unknown extension is an error."""
    if wanted:
        if wanted not in set(FORMATS.values()):
            raise ValueError(f"unknown format {wanted!r}")
        return wanted
    if path is None:
        return "table"
    found = FORMATS.get(Path(path).suffix.lower())
    if found is None:
        raise ValueError(f"can't tell a format from {path!r}; name one of {', '.join(sorted(set(FORMATS.values())))}")
    return found


def text_of(v) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else v.isoformat(sep=" ") if hasattr(v, "hour") else str(v)


def table(df: DataFrame, most: int = 10_000) -> str:
    """Rows in a frame of dashes. A screen is what this is for, so rows end at ``most``, and the text says so."""
    rows = df.limit(most + 1).collect()
    cells = [df.columns, *[[text_of(v) for v in r] for r in rows[:most]]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "|" + "|".join(f" {c.ljust(w)} " for c, w in zip(r, widths, strict=True)) + "|"
    out = [rule, line(cells[0]), rule, *map(line, cells[1:]), rule]
    return "\n".join(out) + (f"\n(the first {most} rows)" if len(rows) > most else "")


def streamed(df: DataFrame):
    """Arrow batches of a result, a partition at a time at the driver."""
    import pyarrow as pa

    def packed(batches):
        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["raw"])

    for row in df.mapInArrow(packed, "raw binary").toLocalIterator(prefetchPartitions=True):
        yield from pa.ipc.open_stream(row["raw"])


def write(df: DataFrame, path: str, wanted: str | None = None, single: bool = True) -> None:
    """One file where ``single``, streamed through the driver; else a folder that the executors write."""
    kind = format_for(path, wanted)
    if not single:
        w = df.write.mode("overwrite")
        {"csv": lambda: w.option("header", True).csv(path), "ndjson": lambda: w.option("ignoreNullFields", False).json(path), "parquet": lambda: w.option("compression", "zstd").parquet(path)}[kind]()
        return
    if kind == "table":
        Path(path).write_text(table(df) + "\n")
    elif kind == "parquet":
        import pyarrow.parquet as pq

        with pq.ParquetWriter(path, df.limit(0).toArrow().schema, compression="zstd", compression_level=3) as writer:
            for batch in streamed(df):
                writer.write_batch(batch.cast(writer.schema))
    else:
        import csv

        with open(path, "w", newline="") as f:
            if kind == "csv":
                out = csv.writer(f, lineterminator="\n")
                out.writerow(df.columns)
                for r in df.toLocalIterator(prefetchPartitions=True):
                    out.writerow([text_of(v) for v in r])
            else:
                names = df.columns
                for r in df.select(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator(prefetchPartitions=True):
                    f.write(r["j"] + "\n")


def data(value) -> str:
    """A report as JSON."""
    return json.dumps(value, ensure_ascii=False, indent=2, default=str)
