"""SentencePiece encoding and decoding on a relational lattice.

A text becomes the model's form: a space is written as U+2581 and one goes in front. It is cut into units where
no piece of the model can cross: before a run of U+2581, and, if the model's pieces allow, between letters and
other characters. Units repeat, so each different one is encoded once, whatever its length: its substrings, up to the
length of the longest piece that has their last characters, are exploded and equi-joined to the piece table, the edges
are grouped by unit, and ``aggregate`` folds Viterbi over them in order of their ends, in blocks of ``BLOCK`` ends so that
no array is copied as often as a long unit has ends. A character without a piece of its own is an edge of the lowest
score and is written as the byte pieces of its UTF-8 form. Of paths with equal sums the one whose last piece, and so on
backwards, is longer wins. Sums are of fixed-point scores of 31 bits: exact for whole scores, and alike in any order.

The path has the largest sum of the model's piece scores. For a model of unigram type that is SentencePiece's
own encoding; a model of BPE type has merge ranks as its scores and its library merges by them one by
one, so ids can differ from the library's while they decode to the same text.

A document's ids are those of its units, put together in order. The most frequent units go to the documents by broadcast,
``HOT_BYTES`` of them at most; each other unit is sent to the documents that hold it by shuffled joins.

Edge cases: a null or empty text has no pieces and decodes to the empty text; rows that repeat give a row each; a U+2581
of the text itself decodes to a space, as the model's form can't tell them apart; an empty table gives an empty
result; other columns are not looked at. Memory is bounded by the edges of the longest unit and by the longest text.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mudlark.llm.common import KEPT, cut, forget, release, ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Ends that a fold goes over at a time; words that a task counts at a time, and whose ids it remembers; units of a task.
BLOCK, COUNTED, HELD, TASK = 256, 800_000, 400_000, 25_000
#: Edges that go to Python at a time.
EDGES = 16_384
#: Bytes of units and ids that are broadcast, as Python holds them; ids that are spelled at a time.
HOT_BYTES, SPELLED = 80 << 20, 1 << 18
#: Characters at the end of a substring by which the length of its pieces is bounded.
TAIL = 4
#: An edge as a long: fixed-point score, 22 bits of id (or UNKNOWN and the code point), 8 bits of length.
UNKNOWN = 1 << 21
#: Characters of two bytes that a pattern's word class has besides letters, decimal digits and the low line.
NUMBERS = "".join(c for c in re.findall(r"[^\W\d_]", "".join(map(chr, range(0xD800)))) if not c.isalpha())
LETTERS = re.compile(rf"{SPACE}*(?:[^\W\d_{NUMBERS}]+|(?:[\d_{NUMBERS}]|[^\w{SPACE}])+)|{SPACE}+")
#: Most of what follows the letters of a word; all of it is in the second class of the pattern.
AFTER = "".join(c for c in map(chr, range(128)) if not c.isalpha() and c != " ")
#: What the pattern finds in ASCII.
PLAIN = re.compile("[A-Za-z]+|[^A-Za-z]+")
WORDS = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass(frozen=True)
class Pieces:
    table: list[tuple[str, int, int]]  # text, id, fixed-point score
    longest: int
    unknown: int
    byte_ids: list[int]
    cut: str  # what no piece crosses: "letters", "words" or "texts"

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(m.is_byte(i) for i in byte_ids):
            raise ValueError("this model has no byte pieces for unknown characters")
        texts = {i: m.id_to_piece(i) for i in ids}
        longest = max(map(len, texts.values()))
        if longest > 255 or m.get_piece_size() > UNKNOWN:
            raise ValueError("this model's pieces are too long or too many")
        scores = {i: m.get_score(i) for i in ids}
        unknown = min(scores.values()) - 10
        scale = 2.0 ** (30 - math.ceil(math.log2(max(1.0, -unknown, max(scores.values())))))
        crosses = any(SPACE in t.lstrip(SPACE) for t in texts.values())
        plain = all(len(LETTERS.findall(t)) == 1 for t in texts.values())
        return cls([(t, i, round(scores[i] * scale)) for i, t in texts.items()], longest, round(unknown * scale), byte_ids, "texts" if crosses else "letters" if plain else "words")

    def voice(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that ids spell, one after another, and where those of each id start and how many they are."""
        known = {i: t.replace(SPACE, " ").encode() for t, i, _ in self.table} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        raw = [known.get(i, b"") for i in range(max(known) + 1)]
        sizes = np.array([len(x) for x in raw], np.int64)
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes


def words_of(text: str | None) -> list[str]:
    """The text cut at its spaces. Where two spaces meet, one is in front, or a U+2581 is in it: its form cut before each run of U+2581."""
    if not text:
        return []
    if text[0] == " " or "  " in text or SPACE in text:
        return WORDS.findall(SPACE + text.replace(" ", SPACE))
    return text.split(" ")


def splitter(cut: str) -> tuple[Callable[[str | None], list[str]], Callable[[str], list[str]]]:
    """How to cut a text into words, and a word into units; put together in order they are the model's form."""
    if cut == "texts":
        return lambda t: [SPACE + t.replace(" ", SPACE)] if t else [], lambda w: [w]
    formed = lambda w: w if w.startswith(SPACE) else SPACE + w
    if cut == "words":
        return words_of, lambda w: [formed(w)]

    def apart(w: str) -> list[str]:
        # Letters alone are one unit, and what follows them is one; ASCII has one run after another. The pattern would find the same.
        if w.isalpha():
            return [SPACE + w]
        core = w.rstrip(AFTER)
        if core.isalpha():
            return [SPACE + core, w[len(core) :]]
        if w and w.isascii():
            units = PLAIN.findall(w)
            units[0] = SPACE + units[0]
            return units
        return LETTERS.findall(formed(w))

    return words_of, apart


def texts_of(batch: pa.RecordBatch, column: str = "text", rows: int = 256) -> Iterator[tuple[int, list[str | None]]]:
    for at in range(0, batch.num_rows, rows):
        yield at, batch.column(column).slice(at, rows).to_pylist()


def count_units(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Every different unit of the texts and its number. A task counts ``COUNTED`` words at a time before it shuffles."""
    how = pieces.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, apart = splitter(how)
        seen: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            found: dict[str, int] = {}
            before = found.get
            for w, n in seen.items():
                for u in apart(w):
                    found[u] = before(u, 0) + n
            seen.clear()
            units, times = list(found), list(found.values())
            for k in range(0, len(units), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(units[k : k + 10_000], pa.string()), pa.array(times[k : k + 10_000], pa.int64())], names=["unit", "n"])

        for batch in batches:
            for _, texts in texts_of(batch):
                for t in texts:
                    seen.update(into(t))
                if len(seen) > COUNTED:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n) -> a row an edge, a unit's rows one after another in order of their ends: the unit and n (first row of a unit only), end, edge."""
    spark = words.sparkSession
    # The piece table's size is the model's vocabulary, so both tables are broadcast.
    # They are joined by hash, as a long is found faster than a string; texts are compared after that.
    table = F.broadcast(spark.createDataFrame(pieces.table, "text string, id int, score int").withColumn("key", F.xxhash64("text")))
    bounds: dict[str, int] = {}
    for t, _, _ in pieces.table:
        if len(t) >= TAIL:
            bounds[t[-TAIL:]] = max(bounds.get(t[-TAIL:], 0), len(t))
    # Tails that meet by hash only share the larger bound, which is still one.
    bounded = F.broadcast(spark.createDataFrame(list(bounds.items()) or [("", 0)], "tail string, bound int").groupBy(F.xxhash64("tail").alias("tail")).agg(F.max("bound").alias("bound")))
    ends = words.select("unit", "n", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("end"))
    ends = ends.withColumn("tail", F.when(F.col("end") >= TAIL, F.xxhash64(F.substring("unit", F.col("end") - (TAIL - 1), F.lit(TAIL))))).join(bounded, "tail", "left")
    most = F.least("end", F.coalesce("bound", F.lit(TAIL - 1)))
    spans = ends.select("unit", "n", "end", F.explode(F.sequence(most, F.lit(1), F.lit(-1))).alias("length"))
    spans = spans.withColumn("piece", F.substring("unit", F.col("end") - F.col("length") + 1, F.col("length")))
    # Two bounds and no equality, which would make the text a part of the key.
    same = (F.xxhash64("piece") == F.col("key")) & (F.col("piece") <= F.col("text")) & (F.col("piece") >= F.col("text"))
    found = spans.join(table, same, "left").filter("id is not null or length = 1")
    code = F.coalesce("id", F.ascii("piece") + UNKNOWN).cast("long")
    edge = F.coalesce("score", F.lit(pieces.unknown)).cast("long") * (1 << 30) + code * 256 + F.col("length")
    opens = F.col("end") == 1
    return found.select(F.when(opens, F.col("unit")).alias("unit"), F.when(opens, F.col("n")).alias("n"), "end", edge.alias("edge"))


def grouped(rows: DataFrame) -> DataFrame:
    """Edges grouped by unit: unit, n, and ``cands``, for each end in order the edges there, long ones first.

    The rows of a unit follow one another, as nothing was shuffled since they were exploded; that is checked here.
    """

    def group(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        end, edge = whole["end"].to_numpy(), whole["edge"].to_numpy()
        opens = whole["unit"].is_valid().to_numpy(zero_copy_only=False)
        step = np.diff(end)
        if not opens[0] or (end[opens] != 1).any() or (~opens[1:] & ((step < 0) | (step > 1) | ((step == 0) & (np.diff(edge & 255) >= 0)))).any():
            raise RuntimeError("the edges of a unit came out of order")
        first = np.flatnonzero(np.concatenate([[True], opens[1:] | (step != 0)]))
        inner = pa.ListArray.from_arrays(pa.array(np.append(first, len(end)).astype(np.int32)), pa.array(edge))
        outer = np.append(np.searchsorted(first, np.flatnonzero(opens)), len(first)).astype(np.int32)
        kept = whole.select(["unit", "n"]).filter(pa.array(opens)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(kept[c].combine_chunks() for c in ("unit", "n")), pa.ListArray.from_arrays(pa.array(outer), inner)], names=["unit", "n", "cands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            opens = np.flatnonzero(batch.column("unit").is_valid().to_numpy(zero_copy_only=False))
            if len(opens):
                last = int(opens[-1])
                held.append(batch.slice(0, last))
                if sum(b.num_rows for b in held):
                    yield group(held)
                held = []
                batch = batch.slice(last)
            held.append(batch)
        if sum(b.num_rows for b in held):
            yield group(held)

    return rows.mapInArrow(run, "unit string, n long, cands array<array<long>>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(lattice: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n, cands) -> unit, n and the ids of the best path."""
    length = lambda x: x.bitwiseAND(F.lit(255)).cast("int")
    score = lambda x: F.shiftright(x, 30)
    code = lambda x: F.shiftright(x, 8).bitwiseAND(F.lit((1 << 22) - 1)).cast("int")
    longs = lambda *xs: F.array(*xs).cast("array<bigint>")

    # Forwards: ``near`` has the best sums of the last ends, so an edge of length k looks k entries back.
    def end(near: Column, cands: Column) -> Column:
        return F.concat(near, F.array(F.array_max(F.transform(cands, lambda x: F.element_at(near, -length(x)) + score(x)))))

    def forwards(s: Column, k: Column) -> Column:
        def keep(near: Column) -> Column:
            old = F.greatest(F.size(near) - pieces.longest, F.lit(0))
            return F.struct(F.slice(near, old + 1, F.lit(pieces.longest)).alias("near"), F.concat(s["sums"], F.slice(near, F.size(s["near"]) + 1, F.lit(BLOCK))).alias("sums"))

        return let(F.aggregate(F.slice("cands", k * BLOCK + 1, F.lit(BLOCK)), s["near"], end), keep)

    blocks = F.sequence(F.lit(0), F.expr(f"(size(cands) - 1) div {BLOCK}").cast("int"))
    zero = F.struct(longs(F.lit(0)).alias("near"), longs(F.lit(0)).alias("sums"))
    summed = lattice.withColumn("sums", F.aggregate(blocks, zero, forwards, lambda s: s["sums"]))

    # Backwards: at each node on the path, the first edge whose sum is the node's own.
    def node(s: Column, p: Column) -> Column:
        best = lambda: F.get(F.filter(F.get("cands", p - 1), lambda x: F.get("sums", p - length(x)) + score(x) == F.get("sums", p)), F.lit(0))
        taken = lambda x: F.struct((p - length(x)).alias("at"), F.concat(F.array(x), s["part"]).alias("part"))
        return F.when(p != s["at"], s).otherwise(let(best(), taken))

    def backwards(s: Column, k: Column) -> Column:
        high = F.size("cands") - k * BLOCK
        start = F.struct(s["at"].alias("at"), longs().alias("part"))
        part = F.aggregate(F.sequence(high, F.greatest(high - (BLOCK - 1), F.lit(1)), F.lit(-1)), start, node)
        return let(part, lambda r: F.struct(r["at"].alias("at"), F.concat(F.array(r["part"]), s["parts"]).alias("parts")))

    none = F.struct(F.size("cands").alias("at"), F.array().cast("array<array<bigint>>").alias("parts"))
    path = summed.select("unit", "n", F.aggregate(blocks, none, backwards, lambda s: F.flatten(s["parts"])).alias("path"))

    def spelled(x: Column) -> Column:
        c = code(x) - UNKNOWN
        more = lambda shift: F.shiftright(c, shift).bitwiseAND(F.lit(63)) + 128
        raw = F.when(c < 0x80, F.array(c)).when(c < 0x800, F.array(F.shiftright(c, 6) + 0xC0, more(0))).when(c < 0x10000, F.array(F.shiftright(c, 12) + 0xE0, more(6), more(0)))
        raw = raw.otherwise(F.array(F.shiftright(c, 18) + 0xF0, more(12), more(6), more(0)))
        ids = F.array(*[F.lit(i) for i in pieces.byte_ids])
        return F.when(c < 0, F.array(code(x))).otherwise(F.transform(raw, lambda b: F.element_at(ids, b + 1)))

    strange = F.exists("path", lambda x: code(x) >= UNKNOWN)
    return path.select("unit", "n", F.when(strange, F.flatten(F.transform("path", spelled))).otherwise(F.transform("path", code)).alias("ids"))


def encode_units(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n) of different units -> unit, n, ids."""
    ship(words.sparkSession)
    return fold(grouped(edges(words, pieces)), pieces)


def vocabulary(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Every different unit of the texts with its number and its ids."""
    spark = docs.sparkSession
    ship(spark)
    words = cut(count_units(docs, pieces), "piece-units")
    # Some thousand units are much work and few bytes: they are dealt out by number and not by size.
    tasks = max(2 * spark.sparkContext.defaultParallelism, words.count() // TASK + 1)
    # The rows that go to Python are edges, of a few bytes each.
    found = cut(encode_units(words.repartition(tasks, "unit"), pieces), "piece-vocabulary", EDGES)
    forget(spark, words)
    return found


def frequent(words: DataFrame, most: int | None = None) -> int:
    """The least number of a unit that is broadcast: the more frequent ones have ``most`` bytes at most. Bounded many rows come to the driver, one a step of numbers."""
    cost = F.length("unit") * 2 + F.size("ids") * 4 + 150
    step = F.floor(F.log2("n") * 16)
    rows = words.groupBy(step.alias("step")).agg(F.sum(cost).alias("cost"), F.min("n").alias("least")).collect()
    total, least = 0, 1 << 62
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["cost"]
        if total > (HOT_BYTES if most is None else most):
            break
        least = r["least"]
    return least


class Encoder(dict):
    """The documents' side: the words that broadcast units alone make, with their ids as bytes of int32; others are put together anew with the units in ``own``."""

    def __init__(self, how: str, hot: dict[str, bytes]):
        self.into, self.apart = splitter(how)
        self.hot, self.own = hot, {}

    def _word(self, w: str) -> tuple[list[str], list[bytes | None]]:
        """The units of a new word and their ids, None for those that aren't broadcast; without such, the word is remembered."""
        units = self.apart(w)
        ids = [self.hot.get(units[0])] if len(units) == 1 else list(map(self.hot.get, units))
        if None not in ids:
            if len(self) >= HELD:
                self.clear()
            self[w] = b"".join(ids)
        return units, ids

    def __missing__(self, w: str) -> bytes:
        units, ids = self._word(w)
        if len(ids) == 1:
            return self.own[units[0]] if ids[0] is None else ids[0]
        return b"".join([self.own[u] if x is None else x for u, x in zip(units, ids, strict=True)])

    def rare(self, text: str | None) -> set[str]:
        """The units of a text that aren't broadcast."""
        found = set()
        for w in filterfalse(self.__contains__, set(self.into(text))):
            units, ids = self._word(w)
            if len(ids) > 1:
                found.update(u for u, x in zip(units, ids, strict=True) if x is None)
            elif ids[0] is None:
                found.add(units[0])
        return found

    def encode(self, text: str | None, own: dict[str, bytes]) -> bytes:
        self.own = own
        return b"".join(map(self.__getitem__, self.into(text)))


def encoder_for(name: str, how: str, hot) -> Encoder:
    """The encoder of this Python worker, by the name of its broadcast: tasks of one run share what they remember."""
    if name not in KEPT:
        release()
        table = pa.ipc.open_stream(hot.value).read_all()
        ids = [x for chunk in table["ids"].chunks for x in raw_lists(chunk)]
        KEPT[name] = Encoder(how, dict(zip(table["unit"].to_pylist(), ids, strict=True)))
    return KEPT[name]


def raw_lists(column: pa.Array) -> list[bytes]:
    """Lists of int32 as bytes."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy().astype(np.int32, copy=False)
    return [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def put_together(docs: DataFrame, pieces: Pieces, body: Callable, schema: str) -> DataFrame:
    """``body(doc_ids, texts, ids as bytes of int32)`` makes the result's batches from all documents and their ids."""
    spark = docs.sparkSession
    words = vocabulary(docs.select("text"), pieces)
    least = frequent(words)
    # The driver holds the units as Arrow bytes only; workers make their dictionaries of them.
    table, out = words.filter(F.col("n") >= least).select("unit", "ids").toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    shared, how, name = spark.sparkContext.broadcast(out.getvalue().to_pybytes()), pieces.cut, uuid.uuid4().hex
    del table, out
    rows = docs.select("doc_id", "text")

    def made(encoder: Encoder, doc_ids: pa.Array, texts: list[str | None], own: list[dict[str, bytes]]) -> pa.RecordBatch:
        return body(doc_ids, texts, [encoder.encode(t, x) for t, x in zip(texts, own, strict=True)])

    rest = words.filter(F.col("n") < least).select("unit", "ids")
    if rest.isEmpty():

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = encoder_for(name, how, shared)
            for batch in batches:
                for at, texts in texts_of(batch):
                    yield made(encoder, batch.column("doc_id").slice(at, len(texts)), texts, [{}] * len(texts))

        return rows.mapInArrow(whole, schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(name, how, shared)
        for batch in batches:
            for at, texts in texts_of(batch):
                found = [sorted(encoder.rare(t)) for t in texts]
                keys = np.repeat(batch.column("key").slice(at, len(texts)).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([u for x in found for u in x], pa.string())], names=["key", "unit"])

    # Documents whose keys are equal by chance only share their lists: ids hang on units alone.
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    sent = cut(keyed.select("key", "text").mapInArrow(find, "key long, unit string").join(rest, "unit"), "piece-sent")
    forget(spark, words)
    lists = sent.groupBy("key").agg(F.collect_set(F.struct("unit", "ids")).alias("own"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at, texts in texts_of(batch):
                packed = [None if t is None else press.compress(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, len(texts)) for c in ("key", "doc_id")] + [pa.array(packed, pa.binary())], names=["key", "doc_id", "packed"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = encoder_for(name, how, shared), zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if x is None else press.decompress(x).decode() for x in part.column("packed").to_pylist()]
                own: list[dict[str, bytes]] = []
                for x in part.column("own"):
                    flat = x.values if x.is_valid else None
                    own.append(dict(zip(flat.field("unit").to_pylist(), raw_lists(flat.field("ids")), strict=True)) if flat is not None and len(flat) else {})
                yield made(encoder, part.column("doc_id"), texts, own)

    # Texts go through the shuffle packed.
    packed = keyed.mapInArrow(pack, f"key long, doc_id {doc_type}, packed binary")
    return packed.join(lists, "key", "left").select("doc_id", "packed", "own").mapInArrow(unpack, schema)


def list_of(raw: list[bytes]) -> pa.Array:
    """Bytes of int32 as lists."""
    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), np.int32)))


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text and ``ids`` of every document."""
    pieces = Pieces.load(path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def body(doc_ids: pa.Array, texts: list[str | None], ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(texts, pa.string()), list_of(ids)], names=["doc_id", "text", "ids"])

    return put_together(docs, pieces, body, f"doc_id {kind}, text string, ids array<int>")


def speak(ids: list[bytes], voice: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[str]:
    """The texts that lists of ids spell; the space in front of each goes."""
    raw, start, size = voice
    flat = np.frombuffer(b"".join(ids), np.int32)
    parts = []
    for a in range(0, len(flat), SPELLED):
        x = flat[a : a + SPELLED]
        n = size[x]
        parts.append(raw[np.repeat(start[x] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
    whole = b"".join(parts)
    ends = np.concatenate([[0], np.cumsum(size[flat])])[np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)]
    return [whole[a + (whole[a : a + 1] == b" ") : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, ids) -> doc_id and the text that the ids spell; null ids spell the empty text."""
    voice = Pieces.load(path).voice()
    ship(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = speak([np.array(x or [], np.int32).tobytes() for x in part.column("ids").to_pylist()], voice)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def summary(docs: DataFrame, path: str = MODEL, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian int32), and ``exact``: whether the ids, decoded, are the text (null: empty); ``ids`` too if asked for."""
    pieces = Pieces.load(path)
    voice = pieces.voice()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def body(doc_ids: pa.Array, texts: list[str | None], ids: list[bytes]) -> pa.RecordBatch:
        columns = {"doc_id": doc_ids, "n_pieces": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())}
        columns["exact"] = pa.array([x == (t or "") for x, t in zip(speak(ids, voice), texts, strict=True)], pa.bool_())
        if with_ids:
            columns["ids"] = list_of(ids)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return put_together(docs, pieces, body, f"doc_id {kind}, n_pieces long, ids_sha256 string, exact boolean" + ", ids array<int>" * with_ids)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
