"""A content-addressed WARC archive.

An archive is two Parquet tables below one path. ``payloads`` holds each different payload once, under its
SHA-256. ``records`` holds one row a record: the exact bytes of the record's header block, its type, and the
digest of its payload. Of the records with equal payloads of ``least`` bytes or more, the one with the
smallest id is a ``response`` and the others are ``revisit`` records that refer to it; a smaller payload is
always a response, though its bytes are stored once too. :func:`read` joins the tables, checks every payload
against its digest and gives back whole records, byte for byte as a WARC file holds them; :func:`export`
writes such files.

Edge cases: a null payload is empty; a null url leaves the target line out; ids that repeat with equal
payloads make records alike, so all rows with the smallest id are responses; a null id comes after all others; an empty table makes an
empty archive; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudlark.llm.common import cut, scratch, ship

LEAST = 100
#: The profile of a revisit by equal payload, and a date, for a table has none.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
HIGHEST = 2**63 - 1


def record_id(page_id, digest):
    """A urn made of the id and the digest, so it is the same in every run."""
    name = F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest), 256)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(name, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def headers(records: DataFrame, date: str = DATE) -> DataFrame:
    """Adds ``header``: the header block without the empty line that ends it."""
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    optional = lambda c: F.coalesce(c, F.lit(""))
    revisit = F.col("record_type") == "revisit"
    text = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        optional(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", ""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("digest"))))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    )
    return records.withColumn("header", F.encode(text, "UTF-8"))


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Archives (page_id, url, payload binary)."""
    held = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    held = held.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    light = cut(held.select("page_id", "url", "digest", "payload_bytes"), "warc")
    order = F.coalesce(F.col("page_id"), F.lit(HIGHEST))
    firsts = cut(light.groupBy("digest").agg(F.min(order).alias("first")), "warc-first")
    both = light.join(firsts, "digest")
    revisit = (F.col("payload_bytes") >= least) & (order != F.col("first"))
    both = both.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.nullif("first", F.lit(HIGHEST))))
    headers(both).select("page_id", "record_type", "refers_to", "digest", "payload_bytes", "header").write.parquet(f"{path}/records")
    # Ids in the key keep the rows of a hot payload apart until only the first of each is left.
    picked = firsts.withColumnRenamed("first", "_order").withColumnRenamed("digest", "_digest")
    stored = held.withColumn("_order", order).join(picked.hint("shuffle_hash"), "_order").filter(F.col("digest") == F.col("_digest"))
    # One id has one digest at most left, so this needs no shuffle beyond the join's.
    stored.dropDuplicates(["_order", "digest"]).select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record: page_id, record_type, refers_to, digest, payload_bytes, header, ``payload`` (null for a revisit) and ``record``, its bytes in a WARC file.

    A payload that is missing or doesn't match its digest stops the read with an error.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    intact = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match digest "), "digest")).cast("binary"))
    responses = records.filter("record_type = 'response'").join(payloads.select("digest", intact.alias("payload")), "digest", "left")
    found = F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload for digest "), "digest")).cast("binary"))
    out = responses.withColumn("payload", found).unionByName(records.filter("record_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary")))
    gap = F.lit(b"\r\n\r\n")
    return out.withColumn("record", F.concat("header", gap, F.coalesce("payload", F.lit(b"")), gap))


def parse(records: DataFrame) -> DataFrame:
    """What the bytes of each record say of themselves: ``record`` -> type, digest, content and its length."""
    text = F.decode("header", "UTF-8")
    line = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)", 1)
    return records.withColumn("said_type", line("WARC-Type")).withColumn("said_digest", F.regexp_replace(line("WARC-Payload-Digest"), "^sha256:", "")).withColumn("content", F.expr("substring(record, length(header) + 5, length(record) - length(header) - 8)")).withColumn("said_length", line("Content-Length").cast("long"))


def export(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Writes the archive's records as WARC files below ``out``, one a partition, and returns (file, records, bytes)."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        name, n, size, stream = f"{uuid.uuid4().hex}.warc", 0, 0, None
        for batch in batches:
            for record in batch.column("record"):
                if stream is None:
                    stream = store.open_output_stream(f"{root}/{name}")
                stream.write(record.as_buffer())
                n, size = n + 1, size + len(record.as_buffer())
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

    return cut(read(spark, path).select("record").mapInArrow(run, "file string, records long, bytes long"), "warc-files")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archive")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write(pages.select("page_id", "url", F.encode("html", "UTF-8").alias("payload")), path)
    back = parse(read(spark, path))
    # A response speaks through its stored bytes; a revisit has none and speaks through its header.
    response = F.col("said_type") == "response"
    size = F.when(response, F.length("content").cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.when(response, F.sha2("content", 256)).otherwise(F.col("said_digest"))
    return back.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("said_type").alias("record_type"), "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> lead THEN lead END AS refers_to
FROM f
"""
