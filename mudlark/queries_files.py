"""Queries that write a whole table as a messy file and read it back, by inference unless they say otherwise."""

from __future__ import annotations

import json
import lzma
import os
import shutil
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from mudlark import sinks, sqlscan
from mudlark.functions import numfmt
from mudlark.functions.text import sanitize, unique
from mudlark.operators import profile
from mudlark.plans import compiler, draft, fit, pile, sniff, target
from mudlark.queries import HEADED, PILE, folder, nation_rows, query, read, sql
from mudlark.session import Session, save
from mudlark.spec import ColumnSpec, Extraction, ParseSpec
from mudlark.streaming import events

BALANCE = "CAST(round(c_acctbal, 2) AS DECIMAL(15,2))"
CUSTOMER_SQL = f"SELECT c_custkey AS key, c_name AS name, {BALANCE} AS balance, c_mktsegment AS segment FROM customer"


def customers(spark, sf_dir):
    """The table by key, its columns named as in the SQL."""
    df = read(spark, sf_dir, "customer")
    return df.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(15,2)").alias("balance"), F.col("c_mktsegment").alias("segment")).orderBy("key", "name", "balance", "segment")


def german(x: Column) -> Column:
    return F.translate(F.format_number(x, 2), ",.", ".,")


def plain(x: Column) -> Column:
    return x.cast("string")


def fields(*columns: Column) -> Column:
    """A line of fields; null is an empty one, and what would end a field is quoted."""
    bare = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(";", *[F.when(c.rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in bare])


def lines(df, shown=german, more: Column | None = None):
    """Customers as lines of a file, still in their order."""
    line = fields(F.col("key"), F.col("name"), shown(F.col("balance")), F.col("segment"))
    return df.select(line if more is None else F.concat(line, more))


def told(df, names=("key", "name", "balance", "segment")):
    """The columns by place, in the types that the SQL has."""
    kinds = ("bigint", "string", "decimal(15,2)", "string")
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(n) for c, kind, n in zip(df.columns, kinds, names, strict=False)])


def put(spark, name: str, data: str | bytes, encoding: str = "utf-8") -> str:
    path = folder(spark) / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode(encoding))
    return str(path)


HEAD = "Key;Name;Balance;Segment\n"


def put_lines(spark, name: str, df, head: str = HEAD, tail: str = "", encoding: str = "utf-8", pack=bytes) -> str:
    """A file of the only column's lines, in the order of their rows. Executors write pieces of it beside it, which are then put together."""
    path = folder(spark) / name

    def written(batches):
        piece = f"{path}.{uuid.uuid4().hex}"
        with open(piece, "wb") as f:
            for batch in batches:
                if batch.num_rows:
                    f.write(pack("".join(x + "\n" for x in batch.column(0).to_pylist()).encode(encoding)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([piece])], names=["place", "piece"])

    pieces = sorted(tuple(r) for r in df.toDF("line").mapInArrow(written, "place int, piece string").collect())
    with open(path, "wb") as f:
        f.write(pack(head.encode(encoding)) if head else b"")
        for _, piece in pieces:
            with open(piece, "rb") as g:
                shutil.copyfileobj(g, f, 1 << 20)
            os.unlink(piece)
        f.write(pack(tail.encode(encoding)) if tail else b"")
    return str(path)


@query("f1_sniffed_numbers", CUSTOMER_SQL)
def sniffed_numbers(spark, sf_dir):
    return told(Session(spark, write=False).table(put_lines(spark, "c.csv", lines(customers(spark, sf_dir)), encoding="cp1252")))


@query("f4_no_header", CUSTOMER_SQL)
def no_header(spark, sf_dir):
    return told(Session(spark, write=False).table(put_lines(spark, "c.csv", lines(customers(spark, sf_dir)), "")))


@query("f9_footer", f"SELECT count(*) AS n, CAST(sum({BALANCE}) AS DECIMAL(25,2)) AS total FROM customer")
def footer(spark, sf_dir):
    rows = customers(spark, sf_dir)
    total = rows.agg(F.coalesce(german(F.sum("balance")), F.lit(""))).first()[0]
    path = put_lines(spark, "c.csv", lines(rows), tail=f"Total;;{total};\n")
    df = told(Session(spark, write=False).table(path))
    return df.agg(F.count("*").alias("n"), F.sum("balance").cast("decimal(25,2)").alias("total"))


@query("f13_missing_words", f"SELECT c_custkey AS key, c_name AS name, CASE WHEN c_acctbal >= 0 THEN {BALANCE} END AS balance, c_mktsegment AS segment FROM customer")
def missing_words(spark, sf_dir):
    return told(Session(spark, write=False).table(put_lines(spark, "c.csv", lines(customers(spark, sf_dir), lambda b: F.when(b < 0, "n/a").otherwise(german(b))))))


LEVELS = ("INFO", "CRITICAL", "warn")


@query("f5_log_lines", "SELECT CASE s_nationkey % 3 WHEN 0 THEN 'INFO' WHEN 1 THEN 'CRITICAL' ELSE 'warn' END AS level, 'supplier=' || s_suppkey || ' name=' || s_name AS message FROM supplier")
def log_lines(spark, sf_dir):
    rows = sorted(tuple(r) for r in read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").collect())
    text = "".join(f"2024-03-01T12:00:{k % 60:02d}.250Z [{LEVELS[n % 3]}] supplier={k} name={name}\n  and a line that continues it\n" for k, name, n in rows)
    return Session(spark, write=False).table(put(spark, "s.log", text)).select("level", "message")


@query("f6_sniffed_widths", "SELECT s_suppkey AS key, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")
def sniffed_widths(spark, sf_dir):
    rows = sorted(tuple(r) for r in read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").collect())
    text = "".join(f"{a!s:<12}{b:<30}{c!s:>8}\n" for a, b, c in [("Key", "Name", "Nation"), *rows])
    df = Session(spark, write=False).table(put(spark, "s.txt", text))
    return df.select(F.col("key").cast("bigint"), "name", F.col("nation").cast("bigint"))


@query("f8_sniffed_json", "SELECT p_partkey AS key, p_name AS name, CASE WHEN p_size > 10 THEN CAST(p_size AS BIGINT) END AS size FROM part")
def sniffed_json(spark, sf_dir):
    size = F.when(F.col("p_size") > 10, F.col("p_size")).alias("size")
    rows = read(spark, sf_dir, "part").orderBy("p_partkey", "p_name", "p_size")
    text = rows.select(F.to_json(F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), size), {"ignoreNullFields": "true"}))
    df = Session(spark, write=False).table(put_lines(spark, "p.ndjson", text, ""))
    return df.select(F.col("key").cast("bigint"), "name", F.col("size").cast("bigint"))


@query("f15_faults", "SELECT 'balance' AS col, count(*) AS n, (SELECT count(*) FROM customer WHERE c_custkey <= (SELECT min(c_custkey) FROM customer WHERE c_custkey % 10 = 0)) AS row, 'x' || min(c_custkey) AS value, 'not a plain number' AS why FROM customer WHERE c_custkey % 10 = 0")
def bad_cells(spark, sf_dir):
    text = customers(spark, sf_dir).select(fields(F.col("key"), F.when(F.col("key") % 10 == 0, F.concat(F.lit("x"), "key")).otherwise(plain(F.col("balance")))))
    spec = ParseSpec(Extraction(delimiter=";"), HEADED, (ColumnSpec("key", "Key", "int64"), ColumnSpec("balance", "Balance", "decimal", precision=15, scale=2)))
    found = compiler.faults(compiler.framed(spark, put_lines(spark, "c.csv", text, "Key;Balance\n"), spec), spec)
    return spark.createDataFrame([(f.column, f.count, f.row, f.value, f.why) for f in found], "col string, n long, row long, value string, why string")


def listed(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame(rows, schema)


HEADS = ["Größe (cm)", "Kunden-Nr.", "2024", "", "Straße", "kunden nr"]


@query("f17_names", "SELECT * FROM (VALUES (1, 'groesse_cm'), (2, 'kunden_nr'), (3, 'c_2024'), (4, 'col'), (5, 'strasse'), (6, 'kunden_nr_2')) AS t(place, name)")
def names(spark, sf_dir):
    return listed(spark, list(enumerate(unique([sanitize(h) for h in HEADS]), 1)), "place int, name string")


@query("f18_confidence", "SELECT 'plain' AS file, true AS sure UNION ALL SELECT 'prose', false")
def confidence(spark, sf_dir):
    table = put_lines(spark, "c.csv", lines(customers(spark, sf_dir)))
    prose = put(spark, "t.txt", "Dear all\nthis is a letter\nand no table\n")
    return listed(spark, [(n, sniff.infer(p).confidence >= 0.9) for n, p in (("plain", table), ("prose", prose))], "file string, sure boolean")


@query("e1_conventions", "SELECT * FROM (VALUES (1, '.', ',', false), (2, ',', '.', false), (3, '''', '.', false), (4, ',', NULL, true), (5, NULL, NULL, false)) AS t(place, thousands, decimal, ambiguous)")
def conventions(spark, sf_dir):
    tried = [["1.234,50", "7,25"], ["1,234.50", "-3.1"], ["1'100.00", "12.5"], ["1,234", "5,678"], ["12", "-7"]]
    found = [numfmt.infer(x) for x in tried]
    return listed(spark, [(i, f.thousands, f.decimal, f.ambiguous) for i, f in enumerate(found, 1)], "place int, thousands string, decimal string, ambiguous boolean")


@query("e3_digits", "SELECT * FROM (VALUES ('0.1', true, false, false), ('007', true, true, true), ('12345678901234567890', false, false, false), ('9223372036854775807', false, false, true)) AS t(text, keeps, zero, long)")
def digits(spark, sf_dir):
    tried = ("0.1", "007", "12345678901234567890", "9223372036854775807")
    return listed(spark, [(t, numfmt.double_keeps(t), numfmt.leading_zero(t), numfmt.fits_long(t)) for t in tried], "text string, keeps boolean, zero boolean, long boolean")


@query("g6_date_order", "SELECT * FROM (VALUES (1, '%d/%m/%Y', NULL), (2, '%d/%m/%Y', '%m/%d/%Y'), (3, '%m/%d/%Y', NULL)) AS t(place, format, rival)")
def date_order(spark, sf_dir):
    tried = [(["01/02/2024", "13/02/2024"], None), (["01/02/2024"], None), (["01/02/2024"], "mdy")]
    return listed(spark, [(i, *fit.date_formats(v, sniff.DATES, o)) for i, (v, o) in enumerate(tried, 1)], "place int, format string, rival string")


@query("g1_target", "SELECT * FROM (VALUES (1, 'n_nationkey', 'int64', false), (2, 'n_name', 'utf8', false), (3, 'note', 'utf8', true)) AS t(place, name, kind, nullable)")
def targets(spark, sf_dir):
    return listed(spark, [(i, c.name, c.dtype, c.nullable) for i, c in enumerate(target.parse(PILE).columns, 1)], "place int, name string, kind string, nullable boolean")


def piled(spark, sf_dir):
    at = folder(spark)
    rows = nation_rows(spark, sf_dir)
    for region in sorted({r[2] for r in rows}):
        (at / f"r{region}.csv").write_text("\n".join(["Key;Name", *[f"{r[0]};{r[1]}" for r in rows if r[2] == region]]) + "\n")
    (at / "nations.mud.sql").write_text(PILE)
    return at, str(at / "nations.mud.sql")


@query("g19_drift", "SELECT 'r' || max(r_regionkey) || '.csv' AS member, 'changed' AS what FROM region UNION ALL SELECT 'rx.csv', 'added'")
def drifted(spark, sf_dir):
    at, path = piled(spark, sf_dir)
    if not pile.fit_pile(spark, path).locked:
        raise ValueError("the pile isn't locked")
    last = max(p.name for p in at.glob("r*.csv"))
    (at / last).write_text("Key;Name\n99;ZZ\n")
    (at / "rx.csv").write_text("Key;Name\n98;YY\n")
    found = [x.split(": ") for x in pile.drift(target.load(path))]
    return listed(spark, [(m, "added" if w.startswith("added") else "changed") for m, w, *_ in found], "member string, what string")


@query("g22_draft", "SELECT 'key' AS name, 'int64' AS kind, false AS optional UNION ALL SELECT 'name', 'utf8', false UNION ALL SELECT 'region', 'int64', true")
def drafted(spark, sf_dir):
    rows, at = nation_rows(spark, sf_dir), folder(spark)
    (at / "a.csv").write_text("".join(f"{a};{b}\n" for a, b, _ in [("Key", "Name", 0), *rows]))
    (at / "b.csv").write_text("".join(f"{a};{b};{c}\n" for a, b, c in [("Key", "Name", "Region"), *rows]))
    t = target.parse(draft.draft([str(at / "a.csv"), str(at / "b.csv")]))
    return listed(spark, [(c.name, c.dtype, c.if_missing == "null") for c in t.columns], "name string, kind string, optional boolean")


for suffix, pack in (("zst", lambda b: zstandard.ZstdCompressor().compress(b)), ("xz", lzma.compress)):

    def packed(spark, sf_dir, suffix=suffix, pack=pack):
        return told(Session(spark, write=False).table(put_lines(spark, f"c.csv.{suffix}", lines(customers(spark, sf_dir)), pack=pack)))

    query(f"a14_{suffix}", CUSTOMER_SQL)(packed)


@query("a15_utf16_be", CUSTOMER_SQL)
def big_endian(spark, sf_dir):
    return told(Session(spark, write=False).table(put_lines(spark, "c.csv", lines(customers(spark, sf_dir)), "\ufeff" + HEAD, encoding="utf-16-be")))


@query("a3_truncate_extra", CUSTOMER_SQL)
def truncated(spark, sf_dir):
    rows = lines(customers(spark, sf_dir), plain, F.when(F.col("key") % 7 == 0, ";more;yet").otherwise(""))
    columns = (ColumnSpec("key", "Key", "int64"), ColumnSpec("name", "Name"), ColumnSpec("balance", "Balance", "decimal", precision=15, scale=2), ColumnSpec("segment", "Segment"))
    return compiler.table(spark, put_lines(spark, "c.csv", rows), ParseSpec(Extraction(delimiter=";", ragged="truncate_extra"), HEADED, columns))


@query("a12_json_record", "SELECT 'k' || r_regionkey AS key, r_name AS name FROM region")
def json_record(spark, sf_dir):
    rows = sorted(tuple(r) for r in read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect())
    df = Session(spark, write=False).table(put(spark, "r.json", json.dumps({f"k{k}": n for k, n in rows})))
    return df.unpivot([], df.columns, "key", "name")


@query("b2_csv", CUSTOMER_SQL)
def to_csv(spark, sf_dir):
    path = str(folder(spark) / "o.csv")
    df = told(read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(15,2)"), "c_mktsegment"))
    sinks.write(df, path)
    return spark.read.csv(f"file://{path}", header=True, schema=df.schema)


@query("b3_ndjson", CUSTOMER_SQL)
def to_ndjson(spark, sf_dir):
    path = str(folder(spark) / "o.ndjson")
    df = told(read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(15,2)"), "c_mktsegment"))
    sinks.write(df, path)
    return spark.read.json(f"file://{path}", schema=df.schema)


@query("b4_parquet", CUSTOMER_SQL)
def to_parquet(spark, sf_dir):
    path = str(folder(spark) / "o.parquet")
    sinks.write(told(read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(15,2)"), "c_mktsegment")), path)
    return spark.read.parquet(f"file://{path}")


PROFILED = "SELECT '{c}' AS col, count(*) AS non_empty, count(DISTINCT {c}) AS uniq, min(CAST({c} AS VARCHAR)) AS least, max(CAST({c} AS VARCHAR)) AS most FROM customer"


def profiled(spark, sf_dir, head=None):
    columns = ["c_mktsegment", "c_nationkey"]
    df = read(spark, sf_dir, "customer").select("c_custkey", *columns)
    found = profile.report(df, columns, row="c_custkey", head=head)["columns"]
    return listed(spark, [(c, x["non_empty"], x["distinct"], x["min"], x["max"]) for c, x in found.items()], "col string, non_empty long, uniq long, least string, most string")


@query("h1_profile", " UNION ALL ".join(PROFILED.format(c=c) for c in ("c_mktsegment", "c_nationkey")))
def whole_profile(spark, sf_dir):
    return profiled(spark, sf_dir)


@query("h8_profile_head", " UNION ALL ".join(PROFILED.format(c=c) + " WHERE c_custkey <= 50" for c in ("c_mktsegment", "c_nationkey")))
def profile_head(spark, sf_dir):
    return profiled(spark, sf_dir, 50)


@query("i5_references", "SELECT * FROM (VALUES (1, 'messy', 'it''s.csv'), (2, 'dataset', 't.mud.sql')) AS t(place, function, path)")
def references(spark, sf_dir):
    text = "SELECT 'messy(''a'')' FROM messy('it''s.csv') -- messy('no')\nJOIN dataset('t.mud.sql') USING (k)"
    return listed(spark, [(i, r.function, r.path) for i, r in enumerate(sqlscan.references(text), 1)], "place int, function string, path string")


@query("i6_frozen", CUSTOMER_SQL)
def frozen(spark, sf_dir):
    path = put_lines(spark, "c.csv", lines(customers(spark, sf_dir)))
    save(path, sniff.sniff(spark, path))
    return told(Session(spark, frozen=True).table(path))


@query(
    "k2_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS n FROM s GROUP BY user_id, k",
)
def sessions(spark, sf_dir):
    out = events.sessions(read(spark, sf_dir, "events"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("first"), F.col("end").cast("timestamp_ntz").alias("until"), "n")


sql("j30_named_struct", "SELECT c_custkey AS k, named_struct('s', c_mktsegment, 'n', c_nationkey).s AS s FROM customer", "SELECT c_custkey AS k, struct_pack(s := c_mktsegment, n := c_nationkey).s AS s FROM customer")
