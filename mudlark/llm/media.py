"""Media columns: payloads in archives, read back by a Spark data source.

A payload is stored as a grey 8-bit PNG, 64 samples a row, whose ``n_bytes`` note holds its length before
padding. Images are stored members of ZIP archives in one directory; every write task makes its own archives
and starts a new one at ``ARCHIVE_BYTES``. The source lists the directory, cuts each archive into byte ranges
and gives each task one: the task takes the members whose headers start in its range from the archive's own
directory of members, reads the range as a stream and hands the members on in Arrow batches. A member that
can't be read or fails its checksum is read again by its offset, alone, up to ``TRIES`` times.

A file counts only if its task's commit message came back, so what lost or repeated tasks leave is not read.

Edge cases: a null or empty text makes 64 zero bytes; a null key is kept as null; repeated rows make
members of their own with equal bytes; an empty table makes no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from mudlark.llm.common import scratch, ship

UNIT, RANGE_BYTES, ARCHIVE_BYTES, BATCH_BYTES, TRIES = 64, 8 << 20, 64 << 20, 4 << 20, 4
MAGIC = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_MEMBERS.json"


def files(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, or of a path of this machine's shared mounts."""
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def encode(raw: bytes) -> bytes:
    """A payload as PNG; equal payloads give equal bytes."""
    payload = padded(raw)
    rows = len(payload) // UNIT
    lines = np.zeros((rows, UNIT + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[bytes, int]:
    """The padded payload and its length before padding. A broken image is a ValueError."""
    if media[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, data, size, rows, ended = 8, [], None, 0, False
    while at < len(media):
        n = struct.unpack_from(">I", media, at)[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) != n or zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"broken chunk at {at}")
        if kind == b"IHDR":
            width, rows, depth, colour, _, _, _ = struct.unpack(">IIBBBBB", body)
            if (width, depth, colour) != (UNIT, 8, 0):
                raise ValueError("not an image of this archive")
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            size = int(body[8:])
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if not ended or size is None or len(lines) != rows * (UNIT + 1) or lines.reshape(rows, UNIT + 1)[:, 0].any():
        raise ValueError("incomplete image")
    return lines.reshape(rows, UNIT + 1)[:, 1:].tobytes(), size


def feature(payload: bytes) -> str:
    """Of an image's samples: mean and deviation, entropy of the histogram in bits, mean step between neighbours, and shares of 16 grey bands in 64ths."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    bands = (counts.reshape(16, 16).sum(1) * 64 + len(x) // 2) // len(x)
    return f"{x.mean():.3f};{x.std():.3f};{abs(-(share * np.log2(share)).sum()):.4f};{step:.3f};" + ".".join(map(str, bands))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    members: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files_of, root = files(self.path)
        names: list[str] = []
        members, archive, out = 0, None, None
        for batch in iterator:
            for key, raw in zip(batch.column("key"), batch.column("raw"), strict=True):
                if archive is None:
                    files_of.create_dir(root, recursive=True)
                    names.append(f"{uuid.uuid4().hex}.zip")
                    out = files_of.open_output_stream(f"{root}/{names[-1]}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                info = zipfile.ZipInfo(f"{members:09d}.png")
                info.comment = b"" if key.as_py() is None else b"=" + key.as_py().encode()
                archive.writestr(info, encode(raw.as_py() or b""))
                members += 1
                if out.tell() >= ARCHIVE_BYTES:
                    archive.close()
                    out.close()
                    archive = None
        if archive is not None:
            archive.close()
            out.close()
        return Written(names, members)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files_of, root = files(self.path)
        files_of.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with files_of.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files_of, root = files(self.path)
        for m in messages:
            for name in m.names if m is not None else []:
                files_of.delete_file(f"{root}/{name}")


@dataclass
class Range(InputPartition):
    name: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, digest: bool):
        self.path, self.digest = path, digest

    def partitions(self) -> list[Range]:
        files_of, root = files(self.path)
        with files_of.open_input_stream(f"{root}/{MANIFEST}") as f:
            names = json.loads(f.read())
        found = files_of.get_file_info([f"{root}/{n}" for n in names])
        return [Range(n, a, a + RANGE_BYTES) for n, i in zip(names, found, strict=True) for a in range(0, i.size, RANGE_BYTES)] or [Range("", 0, 0)]

    def member(self, files_of: pafs.FileSystem, path: str, info: zipfile.ZipInfo, block: bytes | None) -> tuple[bytes, bytes, int]:
        """A member's image, payload and length: from the block that was read, else by its offset."""
        for attempt in range(TRIES):
            try:
                if block is None:
                    with files_of.open_input_file(path) as f:
                        f.seek(info.header_offset)
                        block = f.read(30 + 65_535 * 2 + info.compress_size)
                skip = 30 + sum(struct.unpack_from("<HH", block, 26))
                media = block[skip : skip + info.compress_size]
                if block[:4] != b"PK\x03\x04" or len(media) != info.compress_size or zlib.crc32(media) != info.CRC:
                    raise ValueError("broken member")
                return media, *decode(media)
            except (OSError, ValueError, struct.error, zlib.error) as e:
                if attempt + 1 == TRIES:
                    raise OSError(f"{path}, member at {info.header_offset}: {e}") from e
                block = None
                time.sleep(0.1 * attempt)
        raise AssertionError

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files_of, root = files(self.path)
        path = f"{root}/{partition.name}"
        with files_of.open_input_file(path) as f:
            with zipfile.ZipFile(f) as archive:
                infos = sorted(archive.infolist(), key=lambda i: i.header_offset)
                after = [*(i.header_offset for i in infos[1:]), archive.start_dir]
            own = [(i, e) for i, e in zip(infos, after, strict=True) if partition.start <= i.header_offset < partition.end]
            rows: list[tuple] = []
            held = 0
            for info, end in own:
                try:
                    f.seek(info.header_offset)
                    block = f.read(end - info.header_offset)
                except OSError:
                    block = None
                media, payload, size = self.member(files_of, path, info, block)
                key = info.comment[1:].decode() if info.comment else None
                row = (key, partition.name, info.header_offset, size, len(media), hashlib.sha256(media).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), feature(payload))
                rows.append(row if self.digest else (*row, payload))
                held += 200 + (0 if self.digest else len(payload))
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=COLUMNS[: len(rows[0])])


COLUMNS = ["key", "archive", "offset", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "payload"]


class MediaArchive(DataSource):
    """``mudlark_media``: writes (key string, raw binary); reads members with digests and features and, unless option ``digest`` is true, payloads."""

    @classmethod
    def name(cls) -> str:
        return "mudlark_media"

    def digest(self) -> bool:
        return str(self.options.get("digest", "false")).lower() == "true"

    def schema(self) -> str:
        plain = "key string, archive string, offset long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
        return plain if self.digest() else plain + ", payload binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], self.digest())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"])


def store(docs: DataFrame, path: str) -> None:
    """Writes each row's text, as UTF-8, under its doc_id."""
    ship(docs.sparkSession)
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(F.col("doc_id").cast("string").alias("key"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("raw")).write.format("mudlark_media").mode("append").save(path)


def load(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    ship(spark)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("mudlark_media").option("digest", str(digest).lower()).load(path)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "media")
    store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return load(spark, path, digest=True).select(F.col("key").cast("long").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
