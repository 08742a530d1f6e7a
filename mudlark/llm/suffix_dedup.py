"""Exact removal of byte strings of ``LENGTH`` or more that also start somewhere else.

Every start of a 400-byte window has an anchor: the position, in the window, of the k-gram with the smallest hash
(the last one on ties). The choice depends on the window's bytes only, so equal windows have anchors of equal hash at
equal offsets; a window whose anchor hash occurs once in the corpus can't repeat. Starts with one anchor follow one
another and make a run, with the bytes they cover as its context. Runs whose whole context occurs twice are
repeated as they stand. The other runs of an anchor hash are put together and their suffixes sorted, by mergesort:
two suffixes are compared through prefix polynomial hashes, a binary search for their common extension
and the byte behind it. Neighbours with 400 bytes in common are repeated; their bytes are compared before that counts, and a
hash collision makes the batch sort by bytes instead.

Equal texts, by SHA-256, are one text with a count, so copies never meet in a group. An anchor hash with more than ``HOT``
different contexts is split first: the windows' distances to the anchor are halved, what all windows of a half have in
common is digested with each context, and only contexts that share it stay together; so on until a group is small enough
to be sorted, or a half is one distance, where the digest is that of the whole window.

Edge cases: a null or shorter text than 400 bytes loses nothing; a text with copies loses everything; a
null doc_id is kept; ids that repeat are told apart by text; an empty table gives an empty result. A long text is
cut into pieces that overlap by a window, so memory is bounded by ``PIECE``.

The same method runs over words, ``WORDS``: a text is then the string of its words' 64-bit hashes, a window has 51 of
them, and positions count words. White space between words makes no difference there. A passage of over 50 words has
fewer than 400 bytes as a rule, so ``op3_suffix`` tells in a column of its own how many words such passages cover.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mudlark.llm.common import cut, forget, release, ship, trim

LENGTH, GRAM, PIECE, HOT, BATCH = 400, 128, 1 << 18, 512, 1 << 20
#: Rows up to which ids of texts are broadcast: about 20 MB on the driver and on each executor. More are joined by shuffles.
BROADCAST = 100_000
U = np.uint64


@dataclass(frozen=True)
class Unit:
    """What a window is made of: symbols a window, symbols a k-gram, bytes a symbol."""

    length: int
    gram: int
    width: int

    @property
    def symbol(self) -> type:
        return np.uint8 if self.width == 1 else np.uint64

    def symbols(self, raw: np.ndarray) -> np.ndarray:
        """What the bytes of a text are as symbols of this unit."""
        return raw if self.width == 1 else word_hashes(raw)


BYTES, WORDS = Unit(LENGTH, GRAM, 1), Unit(51, 8, 8)
#: The bytes that part words.
GAPS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: The base is 3 modulo 8, so that powers of two divide differences of its powers as little as can be.
BASE = 0x9E3779B97F4A7C13
INVERSE = pow(BASE, -1, 2**64)
PLACES = U((1 << 21) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)
        self.codes = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(BASE, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * U(pow(INVERSE, k, 2**64))])

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """Prefix polynomial hashes: entry i is the hash of the first i bytes."""
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, U)
        codes = self.codes[data] if data.dtype == np.uint8 else mix(data * U(0x9E3779B97F4A7C15)) | U(1)
        np.cumsum(codes * self.up[: len(data)], out=out[1:])
        return out


POWERS = Powers()


def word_hashes(raw: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """A 64-bit hash of each word: differences of prefix hashes, ``piece`` bytes at a time; longer words by digest."""
    inside = np.concatenate([[False], ~GAPS[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    low, high = edge[::2], edge[1::2]
    out = np.empty(len(low), U)
    at = 0
    while at < len(low):
        stop = max(at + 1, int(np.searchsorted(high, low[at] + piece, "right")))
        a, b = low[at], high[stop - 1]
        if b - a > piece:
            out[at] = int.from_bytes(hashlib.blake2b(raw[a:b].tobytes(), digest_size=8).digest(), "little")
        else:
            sums = POWERS.prefixes(raw[a:b])
            x, y = low[at:stop] - a, high[at:stop] - a
            out[at:stop] = mix((sums[y] - sums[x]) * POWERS.down[x] + (y - x).astype(U) * U(0x9E3779B97F4A7C15))
        at = stop
    return out


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))


def digest_of(raw: Column) -> Column:
    return F.unhex(F.sha2(raw, 256))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window start, and the hash of each k-gram."""
    sums = POWERS.prefixes(data)
    n = len(data) - gram + 1
    grams = mix((sums[gram:] - sums[:n]) * POWERS.down[:n])
    place = np.arange(n, dtype=U)
    least = (grams & ~PLACES) | (PLACES - (place & PLACES))
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return (PLACES - (least & PLACES)).astype(np.int64), grams


def runs(raw: np.ndarray, length: int = LENGTH, piece: int = PIECE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: first start, anchor and anchor hash of each run of window starts."""
    lows, places, hashes = [], [], []
    last = len(raw) - length
    for a in range(0, last + 1, piece):
        part = raw[a : min(a + piece, last + 1) + length - 1]
        at, grams = anchors(part, length, gram)
        new = np.flatnonzero(np.diff(at, prepend=-1))
        lows.append(new + a)
        places.append(at[new] + a)
        hashes.append(grams[at[new]])
    return (np.concatenate(lows), np.concatenate(places), np.concatenate(hashes)) if lows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))


def raw_texts(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid and len(x.as_buffer()) else np.zeros(0, np.uint8)


def survey(docs: DataFrame, units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """One row a document: doc_id, digest (SHA-256 of the bytes), n_bytes, and for unit k its symbols n{k} and runs{k}."""
    ship(docs.sparkSession)

    def starts_of(lows: tuple[np.ndarray, ...], sizes: list[int], length: int) -> np.ndarray:
        """How many window starts each run has: up to the next run, or to the text's last window."""
        return np.concatenate([np.diff(np.append(x, max(n - length + 1, 0))) for x, n in zip(lows, sizes, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = {c: part.column(c) for c in ("doc_id", "digest", "n_bytes")}
                for k, unit in enumerate(units):
                    texts = [unit.symbols(raw) for raw in raw_texts(part.column("raw"))]
                    lows, places, hashes = zip(*(runs(x, unit.length, gram=unit.gram) for x in texts), strict=True)
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lows])]).astype(np.int32))
                    ints = [x.astype(np.int32) for x in (np.concatenate(lows), np.concatenate(places), starts_of(lows, [len(x) for x in texts], unit.length))]
                    flat = [np.concatenate(hashes).view(np.int64), *ints]
                    columns[f"n{k}"] = pa.array([len(x) for x in texts], pa.int64())
                    columns[f"runs{k}"] = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in flat], names=["hash", "low", "place", "starts"]))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("raw")).select("doc_id", digest_of(F.col("raw")).alias("digest"), F.length("raw").cast("long").alias("n_bytes"), "raw")
    schema = rows.drop("raw")
    for k in range(len(units)):
        schema = schema.withColumn(f"n{k}", F.lit(0).cast("long")).withColumn(f"runs{k}", F.array().cast("array<struct<hash:bigint,low:int,place:int,starts:int>>"))
    return rows.mapInArrow(run, schema.schema)


def extract(held: DataFrame, with_bytes: bool, unit: Unit = BYTES) -> DataFrame:
    """(node, raw, asked: low, starts, offset, hash) -> one row a run with the digest of its context, or its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for k in range(batch.num_rows):
                node, raw = batch.column("node")[k].as_py(), memoryview(unit.symbols(next(raw_texts(batch.column("raw").slice(k, 1))))).cast("B")
                for x in batch.column("asked")[k].as_py():
                    low, starts, offset, h = x["low"], x["starts"], x["offset"], x["hash"]
                    context = raw[low * unit.width : (low + starts + unit.length - 1) * unit.width].tobytes()
                    found = hashlib.blake2b(context, digest_size=16, key=b"%d.%d" % (offset, starts)).digest()
                    out.append((node, low, starts, offset, h, found, context if with_bytes else None))
                    size += len(context) if with_bytes else 64
                    if size >= 4 << 20:
                        yield pack(out)
                        out, size = [], 0
            if out:
                yield pack(out)

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = ["node", "low", "starts", "offset", "hash", "context", "bytes"]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return held.select("node", "raw", "asked").mapInArrow(run, "node long, low int, starts int, offset int, hash long, context binary, bytes binary")


class Suffixes:
    """Suffixes of a batch of contexts, all with ``length`` bytes or more, compared by hash."""

    def __init__(self, data: np.ndarray, length: int = LENGTH):
        self.data, self.length, self.sums = data, length, POWERS.prefixes(data)

    def same(self, x: np.ndarray, y: np.ndarray, n) -> np.ndarray:
        a = (self.sums[x + n] - self.sums[x]) * POWERS.down[x]
        b = (self.sums[y + n] - self.sums[y]) * POWERS.down[y]
        return a == b

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bytes two suffixes have in common, ``length`` at most: a binary search."""
        out = np.full(len(x), self.length, np.int64)
        rest = np.flatnonzero(~self.same(x, y, self.length))
        low, high = np.zeros(len(rest), np.int64), np.full(len(rest), self.length - 1, np.int64)
        px, py = x[rest], y[rest]
        for _ in range(self.length.bit_length()):
            middle = (low + high + 1) // 2
            ok = self.same(px, py, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        out[rest] = low
        return out

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.extension(x, y)
        tie = n >= self.length
        at = np.where(tie, 0, n)
        return ~tie & (self.data[x + at] < self.data[y + at])

    def sort(self, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The order of suffixes within their kinds: a bottom-up mergesort, all merges of a level at once.

        ``kind`` ascends. An element's place in a merge is its place in its own run and the number of
        elements of the other run before it, which a binary search finds.
        """
        order = np.arange(len(at))
        starts = np.flatnonzero(np.diff(kind, prepend=kind[0] - 1)) if len(kind) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(kind)))
        base = np.repeat(starts, sizes)
        size = np.repeat(sizes, sizes)
        place = np.arange(len(at)) - base
        run = 1
        while run < (sizes.max() if len(sizes) else 0):
            live = np.flatnonzero(size > run)
            pair = base[live] + place[live] // (2 * run) * (2 * run)
            end = base[live] + size[live]
            middle = np.minimum(pair + run, end)
            right = live >= middle
            other = np.where(right, pair, middle)
            stop = np.where(right, middle, np.minimum(pair + 2 * run, end))
            low, high = other.copy(), stop.copy()
            me = at[order[live]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                probe = (low[open_] + high[open_]) // 2
                them = at[order[probe]]
                # A left element goes before equal right ones.
                ahead = np.where(right[open_], ~self.less(me[open_], them), self.less(them, me[open_]))
                low[open_] = np.where(ahead, probe + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], probe)
            own = live - np.where(right, middle, pair)
            target = pair + own + (low - other)
            new = order.copy()
            new[target] = order[live]
            order = new
            run *= 2
        return order


def repeated(contexts: list[bytes], offsets: list[int], starts: list[int], groups: list[int], length: int = LENGTH, symbol: type = np.uint8) -> list[np.ndarray]:
    """For each context, which of its window starts have an equal window elsewhere in its group."""
    data = np.frombuffer(b"".join(contexts), symbol)
    first = np.cumsum([0, *(len(c) // data.itemsize for c in contexts[:-1])])
    n = np.array(starts)
    owner = np.repeat(np.arange(len(contexts)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = first[owner] + step
    # Equal windows have equal groups and equal distances to their anchors.
    kind = np.array(groups)[owner] * (1 << 20) + np.array(offsets)[owner] - step
    by_kind = np.argsort(kind, kind="stable")
    at, kind = at[by_kind], kind[by_kind]
    suffixes = Suffixes(data, length)
    order = suffixes.sort(at, kind)
    x, y = at[order[:-1]], at[order[1:]]
    near = np.flatnonzero(kind[:-1] == kind[1:])
    near = near[suffixes.same(x[near], y[near], length)]
    if collides(data, x[near], y[near], length):
        order = np.array(sorted(range(len(at)), key=lambda i: (kind[i], data[at[i] : at[i] + length].tobytes())), np.int64)
        x, y = at[order[:-1]], at[order[1:]]
        near = np.array([i for i in np.flatnonzero(kind[:-1] == kind[1:]) if (data[x[i] : x[i] + length] == data[y[i] : y[i] + length]).all()], np.int64)
    flag = np.zeros(len(at), bool)
    flag[order[near]] = True
    flag[order[near + 1]] = True
    back = np.empty(len(at), bool)
    back[by_kind] = flag
    return np.split(back, np.cumsum(n)[:-1])


def collides(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> bool:
    """Whether windows of equal hash differ in bytes: pairs that follow one another are compared as one slice."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    new = np.flatnonzero((np.diff(x, prepend=-9) != 1) | (np.diff(y, prepend=-9) != 1))
    ends = np.append(new[1:], len(x))
    raw, w = memoryview(data).cast("B"), data.itemsize
    return any(raw[x[a] * w : (x[b - 1] + length) * w] != raw[y[a] * w : (y[b - 1] + length) * w] for a, b in zip(new, ends, strict=True))


def ranges(flag: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last index of each stretch of true."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def sort_groups(contexts: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """(hash, context, skip, offset, starts, bytes), grouped by hash in partitions -> context and its repeated starts."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        # Contexts may be parts of contexts; ``skip`` starts go before them.
        flags = repeated([r[4] for r in rows], [r[2] for r in rows], [r[3] for r in rows], list(np.unique([r[0] for r in rows], return_inverse=True)[1]), unit.length, unit.symbol)
        found = [(r[1], *([x + r[5] for x in ends] for ends in ranges(f))) for r, f in zip(rows, flags, strict=True) if f.any()]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.int32()))], names=["context", "begins", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("hash", "context", "offset", "starts", "bytes", "skip")), strict=True):
                if rows and size >= BATCH and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield flush(rows)

    return contexts.select("hash", "context", "offset", "starts", "bytes", "skip").mapInArrow(run, "context binary, begins array<int>, ends array<int>")


def split_hot(contexts: DataFrame, unit: Unit = BYTES) -> tuple[DataFrame, DataFrame]:
    """(context, offset, starts, bytes) of hot hashes -> groups for :func:`sort_groups`, and windows that are repeated as they stand.

    A window at distance d to its anchor covers d symbols before it. All windows with d from a to b cover the symbols
    from a before the anchor to ``length`` - b behind it; contexts that differ there share none of them.
    """
    length, width = unit.length, unit.width
    names = ["key", "context", "skip", "offset", "starts", "bytes", "a", "b"]
    schema = "key binary, context binary, skip int, offset int, starts int, bytes binary, a int, b int"

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for key, context, skip, offset, starts, raw, a, b in zip(*(batch.column(c).slice(at, 512).to_pylist() for c in names), strict=True):
                    middle = (a + b) // 2
                    for low, high in ((a, middle), (middle + 1, b)):
                        first, stop = max(0, offset - high), min(starts, offset - low + 1)
                        if first < stop:
                            core = raw[(offset - low) * width : (offset + length - high) * width]
                            found = hashlib.blake2b(core, digest_size=16, key=key + b"%d.%d" % (low, high)).digest()
                            rows.append((found, context, skip + first, offset - first, stop - first, raw[first * width : (stop + length - 1) * width], low, high))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    start = F.unhex(F.hex("hash")).alias("key")
    rows = contexts.select(start, "context", F.lit(0).alias("skip"), "offset", "starts", "bytes", F.lit(0).alias("a"), F.lit(length - unit.gram).alias("b"))
    groups, same = [], []
    while True:
        parts = cut(rows.mapInArrow(halves, schema), "suffix-halves")
        # Written, so that a hot key can be split where parts are joined with it.
        sizes = cut(parts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-sizes")
        kept = cut(parts.join(sizes, "key"), "suffix-shared")
        same.append(kept.filter("a = b").select("context", F.array("skip").alias("begins"), F.array("skip").alias("ends")))
        groups.append(kept.filter(f"a < b and n <= {HOT}").select(F.xxhash64("key").alias("hash"), "context", "skip", "offset", "starts", "bytes"))
        rows = kept.filter(f"a < b and n > {HOT}").drop("n")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, groups), reduce(DataFrame.unionByName, same)


def texts_once(docs: DataFrame, units: tuple[Unit, ...] = (BYTES,)) -> tuple[DataFrame, DataFrame]:
    """The survey of all documents, and its nodes: one a text, with its first id and number of copies."""
    signed = cut(survey(docs.select("doc_id", "text"), units), "suffix-survey")
    kept = [F.first(f"{c}{k}").alias(f"{c}{k}") for k in range(len(units)) for c in ("n", "runs")]
    nodes = signed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), *kept)
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "suffix-nodes")
    # The runs are with the nodes now; of documents only their names are kept.
    named = cut(signed.select("doc_id", "digest", "n_bytes"), "suffix-documents")
    forget(docs.sparkSession, signed)
    trim(docs.sparkSession)
    return named, nodes


def spans(docs: DataFrame, nodes: DataFrame, unit: Unit = BYTES, k: int = 0) -> tuple[DataFrame, DataFrame]:
    """For unit ``k`` of a survey: nodes with their removed ``pieces``, and the texts of nodes that may lose a part."""
    docs, size = docs.select("doc_id", "text"), F.col(f"n{k}")
    every = nodes.select("node", F.explode(f"runs{k}").alias("run")).select("node", "run.*")
    # A hash that occurs at two places. Written, so that the join below is of two shuffles and a hot hash can be split.
    ends = [f(c).alias(f"{n}_{c}") for c in ("node", "place") for n, f in (("low", F.min), ("high", F.max))]
    twice = cut(every.groupBy("hash").agg(*ends).filter("low_node <> high_node or low_place <> high_place").select("hash"), "suffix-twice")
    asked = F.struct("low", "starts", (F.col("place") - F.col("low")).alias("offset"), "hash").alias("run")
    runs = cut(every.join(twice, "hash").select("node", asked), "suffix-asked")
    wanted = cut(runs.groupBy("node").agg(F.collect_list("run").alias("asked")), "suffix-wanted")
    forget(docs.sparkSession, twice, runs)

    own = docs.select("doc_id", text_bytes(F.col("text")).alias("raw")).withColumn("digest", digest_of(F.col("raw")))
    ids = wanted.select("node").join(nodes.select("node", "first", "digest"), "node").select("node", F.col("first").alias("_first"), F.col("digest").alias("_digest"))
    held = own.join(F.broadcast(ids) if wanted.count() <= BROADCAST else ids, own["doc_id"].eqNullSafe(ids["_first"]) & (own["digest"] == ids["_digest"]))
    texts = cut(held.select("node", "raw").dropDuplicates(["node"]), "suffix-texts")
    trim(docs.sparkSession)

    seen = cut(extract(texts.join(wanted, "node"), False, unit).drop("bytes"), "suffix-contexts")
    each = seen.groupBy("hash", "context").agg(F.count("*").alias("times"), F.min(F.struct("node", "low", "starts", "offset")).alias("one"))
    each = cut(each, "suffix-each")
    per = each.groupBy("hash").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    several = each.join(per, "hash")
    again = F.struct(F.col("one.low").alias("low"), F.col("one.starts").alias("starts"), F.col("one.offset").alias("offset"), "hash").alias("run")
    bytes_of = texts.join(several.select(F.col("one.node").alias("node"), again).groupBy("node").agg(F.collect_list("run").alias("asked")), "node")
    full = extract(bytes_of, True, unit).withColumn("skip", F.lit(0))
    hot = cut(per.filter(F.col("contexts") > HOT).select("hash"), "suffix-hot")
    same = None
    if not hot.isEmpty():
        full = cut(full, "suffix-bytes")
        groups, same = split_hot(full.join(hot, "hash"), unit)
        full = full.join(hot, "hash", "left_anti").select("hash", "context", "skip", "offset", "starts", "bytes").unionByName(groups)
    found = sort_groups(full.repartition("hash").sortWithinPartitions("hash", "context", "skip"), unit)
    found = found if same is None else found.unionByName(same)
    # A context that occurs twice is repeated as a whole, whatever its neighbours are.
    whole = each.filter("times > 1").select("context", F.array(F.lit(0)).alias("begins"), F.array(F.col("one.starts") - 1).alias("ends"))
    found = cut(whole.unionByName(found.join(whole.select("context"), "context", "left_anti")), "suffix-found")
    trim(docs.sparkSession)
    pieces = seen.join(found, "context").select("node", F.explode(F.arrays_zip("begins", "ends")).alias("x"), "low")
    pieces = pieces.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((F.col("low") + F.col("x.begins")).alias("a"), (F.col("low") + F.col("x.ends") + unit.length).alias("b")))).alias("pieces"))
    known = nodes.select("node", "digest", "first", "copies", size.alias("n")).join(pieces, "node", "left")
    gone = (F.col("copies") > 1) & (F.col("n") >= unit.length)
    everything = F.array(F.struct(F.lit(0).alias("a"), F.col("n").cast("int").alias("b")))
    known = known.withColumn("pieces", F.when(gone, everything).otherwise(F.coalesce("pieces", F.array().cast("array<struct<a:int,b:int>>"))))
    return cut(known, "suffix-pieces"), texts


def merged(pieces: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for x in pieces:
        a, b = x["a"], x["b"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remains(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for s in removed for e in s), len(raw)]
    return b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def results(docs: DataFrame, with_text: bool = False, with_words: bool = False) -> DataFrame:
    """doc_id, digest, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    With ``with_text`` also ``kept``, what remains of a text that loses something; with ``with_words`` also
    ``n_passage_words``, the words in passages of ``WORDS.length`` words that also start elsewhere, which stay.
    """
    units = (BYTES, WORDS) if with_words else (BYTES,)
    signed, nodes = texts_once(docs, units)
    known, texts = spans(docs, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"node": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for node, raw, pieces in zip(*(part.column(c) for c in ("node", "raw", "pieces")), strict=True):
                    raw, removed = raw.as_py(), merged(pieces.as_py())
                    left = remains(raw, removed)
                    rows.append((node.as_py(), len(raw) - len(left), len(removed), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    some = known.filter(F.size("pieces") > 0)
    gone = some.filter((F.size("pieces") == 1) & (F.col("pieces")[0]["a"] == 0) & (F.col("pieces")[0]["b"] == F.col("n")))
    part = some.join(gone.select("node"), "node", "left_anti").select("node", "pieces").join(texts, "node").mapInArrow(run, "node long, n_removed long, n_spans long, kept_sha256 string, kept string")
    nothing = hashlib.sha256(b"").hexdigest()
    all_gone = gone.select("node", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"), F.lit("").alias("kept"))
    none = known.filter(F.size("pieces") == 0).select("node", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lower(F.hex("digest")).alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    by_node = part.unionByName(all_gone).unionByName(none)
    if not with_text:
        by_node = by_node.drop("kept")
    if with_words:
        passages, _ = spans(docs, nodes, WORDS, 1)
        by_node = by_node.join(passages.select("node", covered(F.col("pieces")).alias("n_passage_words")), "node")
    by_text = cut(known.select("node", "digest").join(by_node, "node").drop("node"), "suffix-results")
    return signed.select("doc_id", "digest", "n_bytes").join(by_text, "digest")


def covered(pieces: Column) -> Column:
    """How many symbols lie in sorted pieces, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["b"]).alias("end"))
    return F.aggregate(pieces, start, step, lambda s: s["n"])


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with removed bytes cut out of their texts; what is left of a cut character goes too. All columns stay; texts that lose all are empty."""
    names = docs.columns
    found = results(docs, with_text=True).filter("n_removed > 0").groupBy(F.col("digest").alias("_digest")).agg(F.first("kept").alias("_kept"))
    held = docs.withColumn("_own", digest_of(text_bytes(F.col("text"))))
    joined = held.join(found, held["_own"] == found["_digest"], "left")
    return joined.withColumn("text", F.coalesce("_kept", "text")).select(*names)


def without(text: str, removed: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without the white space behind each of them."""
    at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    edges = [0]
    for a, b in removed:
        edges += [at[a][0], at[b][0] if b < len(at) else at[-1][1]]
    edges.append(len(text))
    return "".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def dedup_words(docs: DataFrame, unit: Unit = WORDS) -> DataFrame:
    """The documents without the passages of ``unit.length`` words or more that also start somewhere else. All columns stay."""
    names = docs.columns
    _, nodes = texts_once(docs, (unit,))
    known, _ = spans(docs, nodes, unit)
    some = known.filter(F.size("pieces") > 0).select(F.col("digest").alias("_digest"), F.col("pieces").alias("_pieces"))
    held = docs.withColumn("_own", digest_of(text_bytes(F.col("text"))))
    joined = held.join(some, held["_own"] == some["_digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if p is None else without(t, merged(p)) for t, p in zip(batch.column("text").to_pylist(), batch.column("_pieces").to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*names, "_pieces").mapInArrow(run, docs.schema)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return results(docs, with_words=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")
