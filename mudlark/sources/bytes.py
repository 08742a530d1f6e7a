"""Bytes of a file as text: compression by magic number, encoding by label, byte order mark or content."""

from __future__ import annotations

import bz2
import codecs
import gzip
import io
import lzma
import re
from pathlib import Path
from typing import BinaryIO

MAGIC = {b"\x1f\x8b": "gzip", b"\x28\xb5\x2f\xfd": "zstd", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x04\x22\x4d\x18": "lz4"}
SUFFIXES = (".gz", ".zst", ".bz2", ".xz")
#: What the labels of the web mean where Python's codec of that name differs.
LABELS = {"latin1": "windows-1252", "iso-8859-1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252", "iso8859-1": "windows-1252", "utf8": "utf-8", "iso-8859-9": "windows-1254", "gb2312": "gbk", "shift_jis": "cp932", "sjis": "cp932", "euc-kr": "cp949", "unicode": "utf-16-le"}
MAX_BYTES, MAX_UNPACKED = 4 << 30, 4 << 30


def same_code(e: UnicodeError) -> tuple[str, int]:
    """The five bytes that Python's windows-1252 leaves open stand for the control characters of their numbers."""
    if not isinstance(e, UnicodeDecodeError):
        raise e
    return "".join(map(chr, e.object[e.start : e.end])), e.end


codecs.register_error("mudlark-c1", same_code)


class SourceError(ValueError):
    """A file that can't be read as it is declared."""


def compression(head: bytes, zipped: bool = False) -> str | None:
    for magic, name in MAGIC.items():
        if head.startswith(magic):
            if name == "lz4":
                raise SourceError("lz4 files aren't read; recompress with gzip, zstd, bzip2 or xz")
            return name
    if head.startswith(b"PK\x03\x04") and not zipped:
        raise SourceError("zip archives aren't read; unpack them first")
    return None


class Limited(io.RawIOBase):
    """Stops a stream that unpacks to more than is allowed."""

    def __init__(self, stream: BinaryIO, most: int):
        self.stream, self.left = stream, most

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.stream.read(len(b))
        self.left -= len(data)
        if self.left < 0:
            raise SourceError("the file unpacks to more bytes than allowed")
        b[: len(data)] = data
        return len(data)


def open_plain(path: str, workbook: bool = False, most: int = MAX_UNPACKED) -> BinaryIO:
    """A file's bytes, unpacked if its first bytes say it is compressed."""
    path = path.removeprefix("file://")
    if Path(path).stat().st_size > MAX_BYTES:
        raise SourceError(f"{path} is larger than {MAX_BYTES} bytes")
    f = open(path, "rb")
    kind = compression(f.read(8), workbook)
    f.seek(0)
    if kind is None:
        return f
    if kind == "zstd":
        import zstandard

        stream = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True)
    else:
        stream = {"gzip": lambda f: gzip.GzipFile(fileobj=f), "bzip2": bz2.BZ2File, "xz": lzma.LZMAFile}[kind](f)
    return io.BufferedReader(Limited(stream, most))


def codec(label: str) -> str:
    low = label.strip().lower()
    found = LABELS.get(low, low)
    try:
        return codecs.lookup(found).name
    except LookupError:
        raise SourceError(f"unknown encoding {label!r}") from None


def detect(sample: bytes, whole: bool = True) -> str:
    """The encoding of some bytes: byte order mark, pattern of zero bytes, valid UTF-8, then the likeliest by content."""
    for bom, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if sample.startswith(bom):
            return name
    if len(sample) >= 4:
        even, odd = sample[::2].count(0), sample[1::2].count(0)
        if odd > len(sample) // 6 and even * 8 < odd:
            return "utf-16-le"
        if even > len(sample) // 6 and odd * 8 < even:
            return "utf-16-be"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(sample, final=whole)
        return "utf-8"
    except UnicodeDecodeError:
        pass
    high = re.findall(rb"[\x80-\xff]+", sample)
    if sum(len(x) == 1 for x in high) * 4 >= 3 * len(high):  # lone high bytes: a western text, not an encoding by pairs
        return "cp1252"
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(sample[:65536]).best()
        if best is not None and best.encoding not in ("utf_8", "ascii"):
            return codec(best.encoding) if not best.encoding.startswith(("latin", "iso8859_1", "cp1250", "cp125", "mac")) else "cp1252"
    except ImportError:
        pass
    return "cp1252"


def open_text(path: str, encoding: str | None = None) -> tuple[io.TextIOBase, str]:
    """A file as text with its line ends kept, and the encoding that was used. The byte order mark is taken off."""
    f = open_plain(path)
    if not isinstance(f, io.BufferedReader):
        f = io.BufferedReader(f)
    sample = b""
    if encoding is None:
        with open_plain(path) as g:
            head = g.read(1 << 20)
            sample = head
            name = detect(head, len(head) < 1 << 20)
            if name == "utf-8" and len(head) == 1 << 20:
                check = codecs.getincrementaldecoder("utf-8")()
                try:
                    check.decode(head)
                    while block := g.read(1 << 20):
                        sample = block
                        check.decode(block)
                    check.decode(b"", final=True)
                except UnicodeDecodeError:
                    name = detect(sample, False)
    else:
        name = codec(encoding)
    # Bytes that the encoding doesn't know are an error; windows-1252 knows all, as the web reads it.
    errors = "mudlark-c1" if name == "cp1252" else "strict"
    text = io.TextIOWrapper(f, encoding="utf-8-sig" if name == "utf-8" else name, errors=errors, newline="")
    if name.startswith("utf-16"):
        first = text.read(1)
        if first not in ("\ufeff", ""):
            text = io.TextIOWrapper(open_plain(path), encoding=name, errors=errors, newline="")
    return text, name
