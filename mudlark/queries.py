"""Queries over the driver's tables, one or more an operator, each with the SQL that says what it must give."""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import json
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mudlark.functions import values
from mudlark.operators import profile, regions, transforms
from mudlark.operators.transforms import Frame
from mudlark.plans import compiler, pile
from mudlark.session import Session, configure
from mudlark.spec import ColumnSpec, Extraction, ParseSpec, Transform

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events".split()


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(configure(spark), sf_dir)
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def frame(df: DataFrame, row: Column, names: dict[str, Column], member: Column | None = None) -> Frame:
    """A table as rows of text, the way a reader gives them: ``row`` orders them and needs no window."""
    member = F.lit("m") if member is None else member
    return Frame(df.select(member.cast("string").alias("_member"), row.cast("long").alias("_row"), *[c.cast("string").alias(n) for n, c in names.items()]), tuple(names))


def money(c: str) -> Column:
    return F.col(c).cast("decimal(15,2)")


# Sources: small tables of a fixed number of rows become files, which the readers read back.


def folder(spark: SparkSession) -> Path:
    """A new folder that all executors see, below ``spark.checkpoint.dir``; of this machine where that is unset, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if re.match(r"(?!file:)\w+:", shared):
            raise ValueError(f"these queries write files, which need a mounted folder and not {shared}")
        out = Path(re.sub(r"^file:(//)?", "", shared)) / f"files-{uuid.uuid4().hex}"
        out.mkdir(parents=True)
        return out
    return Path(tempfile.mkdtemp(prefix="mudlark-files-"))


def nation_rows(spark: SparkSession, sf_dir: str) -> list[list]:
    return [list(r) for r in read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


def nation_csv(spark: SparkSession, sf_dir: str) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=";").writerows([["Key", "Name", "Region"], *nation_rows(spark, sf_dir)])
    return out.getvalue()


NATION = (ColumnSpec("n_nationkey", "Key", "int64"), ColumnSpec("n_name", "Name"), ColumnSpec("n_regionkey", "Region", "int64"))
NATION_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
HEADED = (Transform("promote_header", {"rows": 1, "join": " "}),)


@query("a2_delimited", NATION_SQL)
def delimited(spark, sf_dir):
    path = folder(spark) / "nation.csv"
    path.write_text("\ufeff" + nation_csv(spark, sf_dir))
    return compiler.table(spark, str(path), ParseSpec(Extraction(delimiter=";"), HEADED, NATION))


@query("a4_row_window", NATION_SQL + " WHERE n_nationkey >= 4 AND n_nationkey < 9")
def window(spark, sf_dir):
    path = folder(spark) / "nation.csv"
    path.write_text(nation_csv(spark, sf_dir))
    columns = tuple(replace(c, source=f"col_{i + 1}") for i, c in enumerate(NATION))
    return compiler.table(spark, str(path), ParseSpec(Extraction(delimiter=";", region=(5, 10)), (), columns))


@query("a11_ndjson", NATION_SQL)
def ndjson(spark, sf_dir):
    path = folder(spark) / "nation.ndjson.bz2"
    path.write_bytes(bz2.compress("".join(json.dumps(dict(zip(("Key", "Name", "Region"), r, strict=True))) + "\n" for r in nation_rows(spark, sf_dir)).encode()))
    return compiler.table(spark, str(path), ParseSpec(Extraction(format="json", lines=True), (), NATION))


@query("a10_json_pointer", NATION_SQL)
def json_array(spark, sf_dir):
    path = folder(spark) / "nation.json.gz"
    path.write_bytes(gzip.compress(json.dumps({"meta": 1, "data": {"rows/all": [dict(zip(("Key", "Name", "Region"), r, strict=True)) for r in nation_rows(spark, sf_dir)]}}).encode()))
    return compiler.table(spark, str(path), ParseSpec(Extraction(format="json", pointer="/data/rows~1all"), (), NATION))


@query("a23_messy_sql", "SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS n, min(n_name) AS first FROM nation WHERE n_name <> 'x' GROUP BY 1")
def messy_sql(spark, sf_dir):
    path = folder(spark) / "nation.csv"
    path.write_text(nation_csv(spark, sf_dir), encoding="utf-16")
    return Session(spark, write=False).sql(f"SELECT region, count(*) AS n, min(name) AS first FROM messy('{path}') /* messy('no') */ WHERE name <> 'x' GROUP BY region")


PILE = """CREATE TABLE nations (
  n_nationkey BIGINT NOT NULL OPTIONS (matches = 'Key'),
  n_name TEXT NOT NULL OPTIONS (matches = ('Name', 'Land')),
  note TEXT OPTIONS (if_missing = 'null')
) WITH (files = 'r*.csv', provenance = 'true', plans = 'lock');
"""


@query(
    "a24_dataset",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note, 'r' || n_regionkey || '.csv' AS _member, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS _row FROM nation",
)
def dataset(spark, sf_dir):
    at = folder(spark)
    rows = nation_rows(spark, sf_dir)
    for region in sorted({r[2] for r in rows}):
        head = "Key;Land" if region % 2 else "Key;Name"
        (at / f"r{region}.csv").write_text("\n".join([head, *[f"{r[0]};{r[1]}" for r in rows if r[2] == region]]) + "\n", encoding="cp1252")
    (at / "nations.mud.sql").write_text(PILE)
    report = pile.fit_pile(spark, str(at / "nations.mud.sql"))
    if not report.locked:
        raise ValueError("\n".join(report.lines()))
    return pile.dataset(spark, str(at / "nations.mud.sql"))


@query("a3_ragged_pad", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS row, n_name AS col_1, CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_nationkey AS VARCHAR) ELSE '' END AS col_2, CASE WHEN n_nationkey % 3 > 1 THEN CAST(n_regionkey AS VARCHAR) ELSE '' END AS col_3 FROM nation")
def ragged(spark, sf_dir):
    cells = F.slice(F.array("n_name", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")), F.lit(1), F.col("n_nationkey") % 3 + 1)
    f = Frame(read(spark, sf_dir, "nation").select(F.lit("m").alias("_member"), (F.col("n_nationkey") + 1).cast("long").alias("_row"), cells.alias("cells")))
    f = transforms.headless(transforms.rectangle(f, "pad_nulls"))
    return f.df.select(F.col("_row").alias("row"), *f.names)


@query("a8_fixed_width", "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def fixed(spark, sf_dir):
    line = F.concat(F.rpad(F.col("s_suppkey").cast("string"), 12, " "), F.rpad("s_name", 30, " "), F.lpad(F.col("s_nationkey").cast("string"), 4, " "))
    rows = read(spark, sf_dir, "supplier").select(F.lit("m").alias("_member"), F.col("s_suppkey").alias("_row"), line.alias("value"))
    return transforms.fixed_width(rows, [("key", 0, 12), ("name", 12, 42), ("nation", 42, 46)]).df.select("key", "name", "nation")


@query("a9_lines", "SELECT CAST(page_id AS BIGINT) AS row, regexp_extract(url, '^(https?)://([^/]+)/(.*)$', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/(.*)$', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)/(.*)$', 3) AS rest FROM pages WHERE regexp_matches(url, '^(https?)://([^/]+)/(.*)$')")
def lines(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(F.lit("m").alias("_member"), F.col("page_id").alias("_row"), F.col("url").alias("value"))
    return transforms.lines_matching(rows, r"^(?P<scheme>https?)://(?P<host>[^/]+)/(?P<rest>.*)$").df.select(F.col("_row").alias("row"), "scheme", "host", "rest")


@query("a17_regions", "WITH t AS (SELECT user_id, event_id, event_id % 7 = 0 AS blank, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), m AS (SELECT *, sum(CAST(blank AS INT)) OVER (PARTITION BY user_id ORDER BY r) AS run FROM t) SELECT CAST(user_id AS VARCHAR) AS member, min(r) - 1 AS first, max(r) AS last, count(*) AS n FROM m WHERE NOT blank GROUP BY user_id, run HAVING count(*) >= 3")
def islands(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("_member"), F.col("event_id").alias("_row"), (F.col("event_id") % 7 == 0).alias("blank"))
    found = regions.islands(transforms.dense(df)).filter(F.col("rows") >= regions.LEAST)
    return found.select(F.col("_member").alias("member"), F.col("start").alias("first"), F.col("end").alias("last"), F.col("rows").alias("n"))


# Structural transforms.


@query("c1_skip_rows", "SELECT n_name AS name FROM nation WHERE n_nationkey BETWEEN 3 AND 22")
def skip(spark, sf_dir):
    return transforms.skip_rows(frame(read(spark, sf_dir, "nation"), F.col("n_nationkey"), {"name": F.col("n_name")}), 3, 2).df.select("name")


@query("c2_promote_header", 'SELECT CAST(n_nationkey AS VARCHAR) AS "Nation key", n_name AS "Nation name", CAST(n_regionkey AS VARCHAR) AS col_3, n_name AS "Nation name_2" FROM nation')
def promote(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    cells = F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"), "n_name")
    head = spark.createDataFrame([("m", -2, ["Nation", "", " ", "Nation"]), ("m", -1, ["key", "name", "", "name"])], "_member string, _row long, cells array<string>")
    head = head.withColumn("cells", F.when(F.col("_row") == -2, F.array(F.lit("Nation"), F.lit(""), F.lit(""), F.lit("Nation"))).otherwise(F.col("cells")))
    f = transforms.promote_header(Frame(head.unionByName(n.select(F.lit("m").alias("_member"), F.col("n_nationkey").cast("long").alias("_row"), cells.alias("cells")))), 2)
    third = f.names[2]
    return f.df.select("Nation key", "Nation name", F.col(f"`{third}`").alias("col_3"), "Nation name_2")


@query("c3_drop_rows_matching", "SELECT p_partkey, p_name, p_brand FROM part WHERE NOT regexp_matches(p_brand, '#[12]') AND NOT regexp_matches(p_name || chr(9) || p_brand, '3' || chr(9) || 'B')")
def drop(spark, sf_dir):
    f = frame(read(spark, sf_dir, "part"), F.col("p_partkey"), {"p_name": F.col("p_name"), "p_brand": F.col("p_brand")})
    f = transforms.drop_rows_matching(transforms.drop_rows_matching(f, "#[12]", "p_brand"), "3\tB")
    return f.df.select(F.col("_row").alias("p_partkey"), "p_name", "p_brand")


def sparse(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return frame(o, F.col("o_orderkey"), {"priority": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(" ")}, F.col("o_custkey"))


@query("c4_fill_down", "SELECT o_orderkey, CAST(coalesce(last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), ' ') AS VARCHAR) AS priority FROM orders")
def fill_down(spark, sf_dir):
    return transforms.fill_down(sparse(spark, sf_dir), ["priority"]).df.select(F.col("_row").alias("o_orderkey"), "priority")


@query("c4_fill_up", "SELECT o_orderkey, CAST(coalesce(first_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), ' ') AS VARCHAR) AS priority FROM orders")
def fill_up(spark, sf_dir):
    return transforms.fill_down(sparse(spark, sf_dir), ["priority"], "up").df.select(F.col("_row").alias("o_orderkey"), "priority")


@query("c5_remove_empty", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0")
def remove_empty(spark, sf_dir):
    gone = F.col("c_custkey") % 7 == 0
    f = frame(read(spark, sf_dir, "customer"), F.col("c_custkey"), {"c_name": F.when(gone, "  ").otherwise(F.col("c_name")), "seg": F.when(gone, F.lit(None)).otherwise(F.col("c_mktsegment"))})
    return transforms.remove_empty(f).df.select(F.col("_row").alias("c_custkey"), "c_name")


@query("c6_transpose", "SELECT CAST(1 AS BIGINT) AS row, list(CAST(r_regionkey AS VARCHAR) ORDER BY r_regionkey)[1] AS a, list(CAST(r_regionkey AS VARCHAR) ORDER BY r_regionkey)[5] AS e FROM region UNION ALL SELECT 2, list(r_name ORDER BY r_regionkey)[1], list(r_name ORDER BY r_regionkey)[5] FROM region")
def transpose(spark, sf_dir):
    f = Frame(read(spark, sf_dir, "region").select(F.lit("m").alias("_member"), F.col("r_regionkey").cast("long").alias("_row"), F.array(F.col("r_regionkey").cast("string"), "r_name").alias("cells")))
    return transforms.transpose(f).df.select(F.col("_row").alias("row"), F.col("cells")[0].alias("a"), F.col("cells")[4].alias("e"))


def customer_names(spark, sf_dir):
    return frame(read(spark, sf_dir, "customer"), F.col("c_custkey"), {"c_name": F.col("c_name")})


@query("c7_split_delimiter", "SELECT c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number FROM customer")
def split_delimiter(spark, sf_dir):
    return transforms.split_column(customer_names(spark, sf_dir), "c_name", ["kind", "number"], {"delimiter": "#"}).df.select(F.col("_row").alias("c_custkey"), "kind", "number")


@query("c7_split_positions", "SELECT c_custkey, substr(c_name, 1, 4) AS a, substr(c_name, 5, 5) AS b, substr(c_name, 10) AS c FROM customer")
def split_positions(spark, sf_dir):
    return transforms.split_column(customer_names(spark, sf_dir), "c_name", ["a", "b", "c"], {"positions": [4, 9]}).df.select(F.col("_row").alias("c_custkey"), "a", "b", "c")


@query("c7_split_regex", "SELECT c_custkey, CASE WHEN c_name LIKE '%7' THEN regexp_extract(c_name, '^(\\w+)#0*(\\d+)7$', 1) ELSE c_name END AS kind, CASE WHEN c_name LIKE '%7' THEN regexp_extract(c_name, '^(\\w+)#0*(\\d+)7$', 2) END AS number FROM customer")
def split_regex(spark, sf_dir):
    return transforms.split_column(customer_names(spark, sf_dir), "c_name", ["kind", "number"], {"regex": r"^(\w+)#0*(\d+)7$"}, "null").df.select(F.col("_row").alias("c_custkey"), "kind", "number")


@query("c8_c9_source_constant", "SELECT r_name, '2025' AS year, 'sales' AS kind, CAST(NULL AS VARCHAR) AS blank FROM region")
def named(spark, sf_dir):
    f = replace(frame(read(spark, sf_dir, "region"), F.col("r_regionkey"), {"r_name": F.col("r_name")}), source={"path": "/data/sales_2025.csv.gz"})
    f = transforms.source_name(f, "year", r"_(?P<y>\d{4})")
    f = transforms.constant(transforms.source_name(f, "kind", "^[a-z]+"), "blank", "")
    return f.df.select(*f.names)


@query("c10_unpivot", "SELECT l_orderkey * 10 + l_linenumber AS id, variable, CAST(value AS DECIMAL(15,2)) AS value FROM (SELECT *, 'quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT *, 'price', l_extendedprice FROM lineitem UNION ALL SELECT *, 'discount', l_discount FROM lineitem UNION ALL SELECT *, 'tax', l_tax FROM lineitem)")
def unpivot(spark, sf_dir):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    f = frame(read(spark, sf_dir, "lineitem"), key, {"id": key, "quantity": money("l_quantity"), "price": money("l_extendedprice"), "discount": money("l_discount"), "tax": money("l_tax")})
    f = transforms.unpivot(f, ["id"], ["quantity", "price", "discount", "tax"])
    return f.df.select(F.col("id").cast("long").alias("id"), "variable", F.col("value").cast("decimal(15,2)").alias("value"))


# Values.


def parsed(raw: Column, c: ColumnSpec) -> Column:
    value, problem = values.parse(raw, c)
    return F.when(problem.isNull(), value).otherwise(F.raise_error(problem).cast(values.spark_type(c))).alias(c.name)


LINE = "l_orderkey * 10 + l_linenumber AS id"


def line_id() -> Column:
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")


@query("d5_d7_accounting", f"SELECT {LINE}, CAST(CASE WHEN l_linenumber % 2 = 0 THEN -round(l_extendedprice, 2) ELSE round(l_extendedprice, 2) END AS DECIMAL(15,2)) AS amount FROM lineitem")
def accounting(spark, sf_dir):
    shown = F.translate(F.format_number(money("l_extendedprice"), 2), ",.", "'.")
    shown = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("("), shown, F.lit(") "))).otherwise(F.concat(F.lit(" CHF "), shown))
    c = ColumnSpec("amount", dtype="decimal", precision=15, scale=2, thousands="'", negative="parentheses", strip=r"^CHF\s*")
    return read(spark, sf_dir, "lineitem").select(line_id(), parsed(shown, c))


@query("d6_d7_continental", f"SELECT {LINE}, CAST(round(l_extendedprice, 2) AS DECIMAL(15,2)) AS amount, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem")
def continental(spark, sf_dir):
    shown = F.translate(F.format_number(money("l_extendedprice"), 2), ",.", ".,")
    amount = ColumnSpec("amount", dtype="decimal", precision=15, scale=2, thousands=".", decimal=",", round="error")
    quantity = ColumnSpec("quantity", dtype="float64", decimal=",")
    return read(spark, sf_dir, "lineitem").select(line_id(), parsed(shown, amount), parsed(F.translate(money("l_quantity").cast("string"), ".", ","), quantity))


@query("d8_decimal_shift", f"SELECT {LINE}, CAST(round(l_extendedprice, 2) AS DECIMAL(15,2)) AS amount, CAST(round(l_extendedprice * 1000, 0) AS BIGINT) AS mills FROM lineitem")
def decimal_shift(spark, sf_dir):
    cents = (money("l_extendedprice") * 100).cast("bigint").cast("string")
    return read(spark, sf_dir, "lineitem").select(line_id(), parsed(cents, ColumnSpec("amount", dtype="decimal", precision=15, scale=2, decimal_shift=-2)), parsed(money("l_extendedprice").cast("string"), ColumnSpec("mills", dtype="int64", decimal_shift=3)))


@query("d9_round_half_away", f"SELECT {LINE}, round(CAST(round(l_extendedprice, 2) AS DECIMAL(15,2)) * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END), 1) AS amount FROM lineitem")
def half_away(spark, sf_dir):
    shown = (money("l_extendedprice") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)).cast("string")
    return read(spark, sf_dir, "lineitem").select(line_id(), parsed(shown, ColumnSpec("amount", dtype="decimal", precision=26, scale=1)))


ORACLES["d9_round_half_away"] = f"SELECT {LINE}, CAST(round(CAST(round(l_extendedprice, 2) AS DECIMAL(15,2)) * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END), 1) AS DECIMAL(26,1)) AS amount FROM lineitem"


@query("d3_d11_missing_bool", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END AS done FROM orders")
def booleans(spark, sf_dir):
    shown = F.when(F.col("o_orderstatus") == "F", " Ja").when(F.col("o_orderstatus") == "P", "N/A ").otherwise("nein")
    return read(spark, sf_dir, "orders").select("o_orderkey", parsed(shown, ColumnSpec("done", dtype="bool", na_values=("n/a",))))


@query("d12_d16_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS german, CAST(o_orderdate AS DATE) AS short, CAST(o_orderdate AS TIMESTAMP) AS stamp, CAST(o_orderdate AS TIMESTAMP) AS millis, CAST(o_orderdate AS DATE) AS serial, date_trunc('month', CAST(o_orderdate AS DATE))::DATE AS month FROM orders")
def dates(spark, sf_dir):
    d = F.col("o_orderdate")
    day = d.cast("date")
    specs = [
        (F.date_format(d, "d.M.yyyy"), ColumnSpec("german", dtype="date", format="%d.%m.%Y")),
        (F.date_format(d, "MM/dd/yy"), ColumnSpec("short", dtype="date", format="%m/%d/%y", year_pivot=50)),
        (F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), ColumnSpec("stamp", dtype="timestamp", format="%Y-%m-%dT%H:%M:%S%.f")),
        (F.unix_micros(d.cast("timestamp")).cast("string"), ColumnSpec("millis", dtype="timestamp", epoch="micros")),
        (F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"), ColumnSpec("serial", dtype="date", epoch="excel")),
        (F.date_format(d, "MMM yyyy"), ColumnSpec("month", dtype="date", format="%b %Y")),
    ]
    return read(spark, sf_dir, "orders").select("o_orderkey", *[parsed(raw, c) for raw, c in specs])


@query("d1_json_pointer", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_pointer(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", parsed(F.col("props"), ColumnSpec("k", dtype="int64", pointer="/k")))


@query("f15_verification", "SELECT 'n' AS column, count(*) FILTER (TRY_CAST(v AS BIGINT) IS NULL) AS n, min(CASE WHEN TRY_CAST(v AS BIGINT) IS NULL THEN o_orderkey END) AS first_row FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END AS v FROM orders)")
def verification(spark, sf_dir):
    """The offenders of a column in one aggregation, without the dense row numbers that a file would have."""
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderkey").cast("string"))
    _, problem = values.parse(raw, ColumnSpec("n", dtype="int64"))
    return read(spark, sf_dir, "orders").agg(F.count_if(problem.isNotNull()).alias("n"), F.min(F.when(problem.isNotNull(), F.col("o_orderkey"))).alias("first_row")).select(F.lit("n").alias("column"), "n", "first_row")


# Profiles.

CUSTOMER = ["c_name", "c_nationkey", "c_mktsegment"]
STACK = "(SELECT 0 AS pos, 'c_name' AS col, c_name AS v FROM customer UNION ALL SELECT 1, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 2, 'c_mktsegment', c_mktsegment FROM customer)"


def customer_cells(spark, sf_dir):
    return profile.stacked(read(spark, sf_dir, "customer"), CUSTOMER, ("building",), "c_custkey")


GONE = "lower(v) = 'building' OR v = ''"


@query("h2_h4_profile_counts", f"SELECT pos, col AS column, count(*) FILTER (NOT ({GONE})) AS non_empty, count(*) FILTER ({GONE}) AS empty, count(DISTINCT CASE WHEN NOT ({GONE}) THEN v END) AS distinct, min(CASE WHEN NOT ({GONE}) THEN v END) AS min, max(CASE WHEN NOT ({GONE}) THEN v END) AS max FROM {STACK} GROUP BY pos, col")
def profile_counts(spark, sf_dir):
    return profile.counts(customer_cells(spark, sf_dir))


@query("h5_profile_top", f"SELECT pos, col AS column, v AS value, n, CAST(rank AS INT) AS rank FROM (SELECT pos, col, v, count(*) AS n, row_number() OVER (PARTITION BY pos ORDER BY count(*) DESC, v) AS rank FROM {STACK} WHERE NOT ({GONE}) GROUP BY pos, col, v) WHERE rank <= 5")
def profile_top(spark, sf_dir):
    return profile.top(customer_cells(spark, sf_dir))


@query("h6_profile_shapes", f"SELECT pos, col AS column, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '[A-Z][A-Z]+', '~U', 'g'), '(^|[^~])[A-Z]', '\\1~V', 'g'), '[a-z]+', 'a+', 'g'), '[0-9]{{9,}}', '9+', 'g'), '[0-8]', '9', 'g') AS s, count(*) AS n FROM {STACK} WHERE NOT ({GONE}) GROUP BY 1, 2, 3")
def profile_shapes(spark, sf_dir):
    found = profile.shapes(customer_cells(spark, sf_dir))
    return found.select("pos", "column", F.replace(F.replace("shape", F.lit("A+"), F.lit("~U")), F.lit("A"), F.lit("~V")).alias("s"), "n")


@query("g14_magnitude", "SELECT l_returnflag AS member, round(median(abs(l_extendedprice)), 4) AS median, count(*) AS n FROM lineitem GROUP BY 1")
def magnitude(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("_member"), F.lit(1).alias("_row"), "l_extendedprice")
    return pile.magnitudes(df, ["l_extendedprice"]).select(F.col("_member").alias("member"), F.round("median", 4).alias("median"), "n")


# Relational SQL: the engine is Spark's; where both dialects agree one text says both.


def sql(name: str, text: str, oracle: str | None = None) -> None:
    def run(spark, sf_dir):
        for t in TABLES:
            if t in text:
                read(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    query(name, oracle or text)(run)


D = "DECIMAL(18,2)"
sql("j1_j4_project_filter", "SELECT l_orderkey AS k, CAST(l_linenumber AS VARCHAR(10)) AS line, l_shipdate AS d FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_quantity > 25 AND l_returnflag <> 'R'", "SELECT l_orderkey AS k, CAST(l_linenumber AS VARCHAR) AS line, l_shipdate AS d FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_quantity > 25 AND l_returnflag <> 'R'")
sql("j5_j7_aggregate", f"SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_tax) AS m, CAST(sum(CAST(l_extendedprice AS {D})) AS DECIMAL(38,2)) AS total, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2")
sql("j8_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
sql("j9_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
sql("j10_distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) t WHERE r = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
sql("j11_self_reference", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
for kind in ("INNER", "LEFT", "RIGHT", "FULL OUTER"):
    sql(f"j12_{kind.split()[0].lower()}_join", f"SELECT c.c_custkey, o.o_orderkey FROM customer c {kind} JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > o.o_totalprice / 100")
sql("j12_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("j12_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
sql("j12_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
sql("j13_theta_join", "SELECT s_suppkey, r_regionkey FROM supplier JOIN region ON s_nationkey > r_regionkey * 5")
sql("j15_range_join", "SELECT p_partkey, lo FROM part JOIN (SELECT r_regionkey * 10 AS lo, r_regionkey * 10 + 10 AS hi FROM region) r ON p_size >= lo AND p_size < hi")
sql("j16_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("j16_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("j16_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("j17_windows", f"SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER w AS INT) AS rk, CAST(dense_rank() OVER w AS INT) AS dr, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, CAST(sum(CAST(o_totalprice AS {D})) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
sql("j20_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql("j21_subqueries", f"SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
sql("j22_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql("j22_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("j22_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("j22_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
sql("j23_unnest", "SELECT p_partkey, word FROM (SELECT p_partkey, explode(split(p_name, ' ')) AS word FROM part) t", "SELECT p_partkey, unnest(string_to_array(p_name, ' ')) AS word FROM part")
sql("j24_j25_strings", "SELECT c_custkey, split_part(c_name, '#', 2) AS part, regexp_extract(c_name, '([A-Z])', 1) AS first, substr(c_name, 3, 4) AS some, c_name || '-' || c_mktsegment AS both FROM customer")
sql("j26_date_trunc", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1")
sql("j27_epochs", "SELECT event_id, CAST(timestamp_seconds(event_id) AS TIMESTAMP_NTZ) AS s, CAST(timestamp_millis(event_id) AS TIMESTAMP_NTZ) AS ms FROM events", "SELECT event_id, make_timestamp(event_id * 1000000) AS s, make_timestamp(event_id * 1000) AS ms FROM events")
sql("j28_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
sql("j29_series", "SELECT s.day, coalesce(n, 0) AS n FROM (SELECT explode(sequence(0, 30)) AS day) s LEFT JOIN (SELECT CAST(o_custkey % 37 AS INT) AS day, count(*) AS n FROM orders GROUP BY 1) o ON s.day = o.day", "SELECT CAST(s.day AS INT) AS day, coalesce(n, 0) AS n FROM generate_series(0, 30) s(day) LEFT JOIN (SELECT o_custkey % 37 AS day, count(*) AS n FROM orders GROUP BY 1) o ON s.day = o.day")
sql("j31_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal IS NOT NULL THEN 'ok' ELSE 'none' END AS state, coalesce(c_mktsegment, '?') AS seg, CAST(least(greatest(floor(c_acctbal / 2000) + 1, 0), 6) AS INT) AS bucket FROM customer")
sql("j33_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS c, round(median(l_quantity), 4) AS md FROM lineitem GROUP BY 1")


@query("j14_as_of_join", "SELECT e.event_id, p.event_id AS prev FROM events e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def as_of(spark, sf_dir):
    """Each event with the user's last purchase by then: one shuffle by user, no join."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("prev"))


@query("k1_tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    from mudlark.streaming.events import tumbling as windows

    out = windows(read(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
