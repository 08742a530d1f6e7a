"""A convolutional text classifier for toxicity, trained in numpy.

Words are lowered, stripped of punctuation and hashed twice, into two tables of embeddings that are joined, so
that two words share a vector only if both hashes agree. Filters of one, two and three words run over the
whole text, each filter keeps its largest value, and a logistic layer makes the score. Training takes all
labelled rows that are not held out: shards of them train apart from one model, and what they changed is put together
after each pass. A fifth of the rows, by hash, is set aside to move the score so that ``THRESHOLD`` is the best cut, and to
find the best cut of every language; all rows of that fifth count, in bins of 1/1024 of a logit.

The score reads the text only. Language enters in ``thresholds`` alone, which :func:`reject` uses.

Edge cases: a null text is an empty text, which scores what the bias says; a null doc_id counts as the empty
string for the split; repeated rows get equal scores; with no labelled rows of both kinds all scores are 0;
an empty table gives an empty result. Texts of any length are read in pieces that overlap by a window.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mudlark.llm.common import cut, forget, release, ship

THRESHOLD = 0.3
BITS, HALF, WIDTHS, FILTERS, PIECE = 17, 8, (1, 2, 3), 8, 65_536
#: Labelled rows of a shard that trains apart, shards at most (they grow then), and words that are held at a time.
SHARD, SHARDS, WORDS_HELD = 6000, 64, 1 << 22
#: Steps of a logit in which cuts are sought.
BINS = 1024
NAMES = ["toxic", "lang", "order", "held"]
EDGE = ".,;:!?\"'()[]{}«»¡¿…-–—*#"


class Words:
    """Hashes words, with a memory that is emptied when it is full."""

    def __init__(self, most: int = 300_000):
        self.known: dict[str, int] = {}
        self.most = most

    def _new(self, word: str) -> int:
        raw = word.lower().strip(EDGE).encode("utf-8", "surrogatepass")
        mask = (1 << BITS) - 1
        # Row 0 of either table stands for the padding and stays zero.
        found = ((zlib.crc32(raw) & mask) or 1) << BITS | ((zlib.crc32(raw, 0x9E3779B9) >> 7 & mask) or 1)
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[word] = found
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        known, new = self.known, self._new
        return np.array([known.get(w) or new(w) for w in (text or "").split()], dtype=np.int64)


@dataclass
class Model:
    first: np.ndarray
    second: np.ndarray
    filters: list[np.ndarray]  # a width's filters: width, 2 * HALF, FILTERS
    bias: np.ndarray
    top: np.ndarray
    constant: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        table = lambda: np.concatenate([np.zeros((1, HALF)), rng.normal(0, 0.05, ((1 << BITS) - 1, HALF))]).astype(np.float32)
        return cls(table(), table(), [rng.normal(0, 0.3, (w, 2 * HALF, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32))

    def rows(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.first[ids >> BITS], self.second[ids & ((1 << BITS) - 1)]], axis=1)

    def maps(self, x: np.ndarray) -> list[np.ndarray]:
        """The filters' values at each place; the last places of ``x`` are padding."""
        n = len(x) - max(WIDTHS) + 1
        return [sum(x[j : j + n] @ f[j] for j in range(len(f))) for f in self.filters]

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """The largest value of each filter in each text."""
        out = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        # Three zeros end a text, so that the window on them holds no word of the next; it counts as the value 0.
        more = max(WIDTHS) - 1
        todo: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            ends = np.cumsum([len(p) for _, p in todo])
            values = np.concatenate(self.maps(self.rows(np.concatenate([*(p for _, p in todo), np.zeros(more, np.int64)]))), axis=1)
            for k in range(1, more + 1):
                values[ends - k] = -np.inf
            np.maximum.at(out, [k for k, _ in todo], np.maximum.reduceat(values, np.concatenate([[0], ends[:-1]]), axis=0))

        for k, ids in enumerate(texts):
            whole = np.concatenate([ids, np.zeros(more + 1, np.int64)])
            for a in range(0, len(ids) + 1, PIECE):
                piece = whole[a : min(a + PIECE, len(ids) + 1) + more]
                todo.append((k, piece))
                size += len(piece)
                if size >= PIECE:
                    flush()
                    todo, size = [], 0
        if todo:
            flush()
        return out

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return np.maximum(self.pooled(texts) + self.bias, 0) @ self.top + self.constant

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts).astype(np.float64), -40, 40)))


class Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, x: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-7)


def _rows_step(table: np.ndarray, seen: np.ndarray, at: np.ndarray, g: np.ndarray, rate: float) -> None:
    """An Adagrad step on the rows of a table that got a gradient."""
    rows, back = np.unique(at, return_inverse=True)
    total = np.zeros((len(rows), g.shape[1]), np.float32)
    np.add.at(total, back, g)
    seen[rows] += total * total
    total[rows == 0] = 0
    table[rows] -= rate * total / (np.sqrt(seen[rows]) + 1e-6)


class Trainer:
    """A model in training: its tables with the squares of their gradients so far, and its dense parts with Adam's moments."""

    def __init__(self, seed: int = 7):
        self.model = model = Model.fresh(seed)
        self.seen = [np.full_like(model.first, 1e-4), np.full_like(model.second, 1e-4)]
        self.dense = [Adam(f.shape, 0.01) for f in model.filters] + [Adam(model.bias.shape, 0.01), Adam(model.top.shape, 0.02), Adam(1, 0.02)]

    def tables(self) -> np.ndarray:
        """A row for each row of either table: its values and the squares of its gradients."""
        parts = zip((self.model.first, self.model.second), self.seen, strict=True)
        return np.concatenate([np.concatenate(x, axis=1) for x in parts])

    def add(self, rows: np.ndarray, more: np.ndarray) -> None:
        """Adds to rows as :meth:`tables` has them."""
        for k, table in enumerate((self.model.first, self.model.second)):
            own = (rows >> BITS) == k
            at = rows[own] & ((1 << BITS) - 1)
            table[at] += more[own, :HALF]
            self.seen[k][at] += more[own, HALF:]

    def flat(self) -> np.ndarray:
        """The dense parts, Adam's moments and steps in one."""
        m = self.model
        return np.concatenate([x.ravel() for x in (*m.filters, m.bias, m.top, np.array([m.constant]), *(y for d in self.dense for y in (d.m, d.v, np.array([d.t]))))]).astype(np.float64)

    def set_flat(self, flat: np.ndarray) -> None:
        at = 0

        def take(x: np.ndarray) -> np.ndarray:
            nonlocal at
            at += x.size
            return flat[at - x.size : at].reshape(x.shape).astype(np.float32)

        m = self.model
        m.filters, m.bias, m.top = [take(f) for f in m.filters], take(m.bias), take(m.top)
        m.constant = float(take(np.zeros(1))[0])
        for d in self.dense:
            d.m, d.v, d.t = take(d.m), take(d.v), float(take(np.zeros(1))[0])

    def epoch(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator, batch: int = 32) -> None:
        """Cross-entropy, weighted. Only a filter's largest place gets its gradient."""
        model, dense, seen = self.model, self.dense, self.seen
        pad, more = np.zeros(max(WIDTHS), np.int64), max(WIDTHS) - 1
        mask = (1 << BITS) - 1
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            flat = [np.concatenate([texts[k], pad]) for k in own]
            starts = np.cumsum([0, *(len(x) for x in flat)])
            ids = np.concatenate([*flat, pad[:more]])
            x = model.rows(ids)
            maps = model.maps(x)
            best = np.stack([np.concatenate([s + m[s : e - more].argmax(0) for m in maps]) for s, e in zip(starts[:-1], starts[1:], strict=True)])  # text, filter
            value = np.concatenate([np.take_along_axis(m, best[:, i * FILTERS : (i + 1) * FILTERS], 0) for i, m in enumerate(maps)], axis=1) + model.bias
            hidden = np.maximum(value, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.top + model.constant, -40, 40)))
            g = ((p - labels[own]) * weight[own] / len(own)).astype(np.float32)
            g_value = np.outer(g, model.top).astype(np.float32) * (value > 0)
            g_top = hidden.T @ g + 1e-4 * model.top
            at, g_x = [], []
            for i, f in enumerate(model.filters):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                gv, places = g_value[:, cols], best[:, cols]
                g_f = np.zeros_like(f)
                for j in range(len(f)):
                    rows = x[places + j]  # text, filter, 2 * HALF
                    g_f[j] = np.einsum("tfd,tf->df", rows, gv)
                    at.append((places + j).ravel())
                    g_x.append((gv[:, :, None] * f[j].T[None]).reshape(-1, 2 * HALF))
                dense[i].step(model.filters[i], g_f)
            dense[-3].step(model.bias, g_value.sum(0))
            dense[-2].step(model.top, g_top)
            constant = np.array([model.constant], np.float32)
            dense[-1].step(constant, np.array([g.sum()], np.float32))
            model.constant = float(constant[0])
            places, grads = ids[np.concatenate(at)], np.concatenate(g_x)
            _rows_step(model.first, seen[0], places >> BITS, grads[:, :HALF], 0.1)
            _rows_step(model.second, seen[1], places & mask, grads[:, HALF:], 0.1)


def _raw(values: np.ndarray) -> pa.Array:
    """Rows of ``2 * HALF`` numbers as bytes of float32."""
    values = np.ascontiguousarray(values, np.float32)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * HALF), len(values), [None, pa.py_buffer(values)]).cast(pa.binary())


def _numbers(raw: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(-1, 2 * HALF)


def summed(parts: DataFrame) -> DataFrame:
    """(at, raw) -> for each ``at`` one row: the mean of its rows for a row of a table, the sum for dense parts, which begin at ``2 << BITS``.

    A group is summed in order of its bytes, so that any order of the shards gives the same model; no number is too large or too small for that.
    """

    def group(at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(at, prepend=-1))
        own, n = at[first], np.diff(np.append(first, len(at)))
        found = np.add.reduceat(values.astype(np.float64), first, axis=0) / np.where(own < 2 << BITS, n, 1)[:, None]
        return pa.RecordBatch.from_arrays([pa.array(own), _raw(found)], names=["at", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = np.zeros(0, np.int64), np.zeros((0, 2 * HALF), np.float32)
        for batch in batches:
            at = np.concatenate([at, batch.column("at").to_numpy()])
            values = np.concatenate([values, _numbers(batch.column("raw"))])
            # The last group can go on in the next batch.
            last = int(np.searchsorted(at, at[-1])) if len(at) else 0
            if last:
                yield group(at[:last], values[:last])
                at, values = at[last:], values[last:]
        if len(at):
            yield group(at, values)

    return parts.repartition("at").sortWithinPartitions("at", "raw").mapInArrow(run, "at long, raw binary")


def _round(rows: DataFrame, counts: tuple[int, int], trainer: Trainer, turn: int) -> Trainer:
    """One pass over all ``rows`` (shard, toxic, ids), ``counts`` of either label: shards train apart, and what they changed is put together.

    A row of a table moves by the mean of the shards that used it; a dense part becomes the mean over all rows, so that
    Adam's second moments, which are not negative in any shard, are not negative after it.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(trainer)
    weights = [0.5 * sum(counts) / max(1, n) for n in counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count, held, size = None, 0, [], 0

        def learn() -> None:
            nonlocal held, size, count
            if held:
                y = np.array([x[0] for x in held], np.float32)
                own.epoch([x[1] for x in held], y, np.where(y == 1, weights[1], weights[0]).astype(np.float32), np.random.default_rng([turn, shard, count]))
                count += len(held)
                held, size = [], 0

        def changed() -> pa.RecordBatch:
            tables, flat = own.tables() - shared.value.tables(), own.flat() * (count / sum(counts))
            used = np.flatnonzero(tables.any(axis=1))
            # Dense parts follow the tables, as rows of the same width.
            flat = np.concatenate([flat, np.zeros(-len(flat) % (2 * HALF))]).reshape(-1, 2 * HALF)
            at = np.concatenate([used, np.arange(len(flat)) + (2 << BITS)])
            return pa.RecordBatch.from_arrays([pa.array(at), _raw(np.concatenate([tables[used], flat]))], names=["at", "raw"])

        shard = None
        for batch in batches:
            for s, y, ids in zip(*(batch.column(c) for c in ("shard", "toxic", "ids")), strict=True):
                if s.as_py() != shard:
                    if own:
                        learn()
                        yield changed()
                    own, count, shard = copy.deepcopy(shared.value), 0, s.as_py()
                held.append((y.as_py(), np.frombuffer(ids.as_py(), np.int64)))
                size += len(held[-1][1])
                if len(held) >= SHARD or size >= WORDS_HELD:
                    learn()
        if own:
            learn()
            yield changed()

    found = cut(summed(rows.select("shard", "toxic", "ids").mapInArrow(run, "at long, raw binary")), "toxicity-round")
    table = found.toArrow().sort_by("at")
    forget(spark, found)
    shared.destroy()
    at, values = table["at"].to_numpy(), _numbers(table["raw"])
    first = int(np.searchsorted(at, 2 << BITS))
    trainer.add(at[:first], values[:first])
    trainer.set_flat(values[first:].ravel()[: len(trainer.flat())])
    return trainer


def train(rows: DataFrame, counts: tuple[int, int], epochs: int = 6, seed: int = 7) -> Model:
    """A model from all ``rows`` (shard, toxic, ids), both labels of equal weight; ``counts`` of either label."""
    trainer = Trainer(seed)
    for turn in range(epochs):
        trainer = _round(rows, counts, trainer, turn)
    return trainer.model


def best_cuts(rows: DataFrame) -> dict:
    """(key, bin, toxic) -> for each key the logit with the highest F1 over all its rows, and its rows of label 0 and 1.

    A cut lies halfway in the gap above the first bin that is left out.
    """
    bins = rows.groupBy("key", "bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    down = Window.partitionBy("key").orderBy(F.desc("bin"))
    whole = Window.partitionBy("key")
    total = F.sum("hits").over(whole)
    f1 = 2 * F.sum("hits").over(down) / (F.sum("n").over(down) + F.greatest(F.lit(1), total))
    low = F.lead("bin").over(down)
    at = F.when(low.isNull(), F.col("bin") / BINS - 1).otherwise((F.col("bin") + low + 1) / (2 * BINS))
    found = bins.select("key", "bin", f1.alias("f1"), at.alias("at"), total.alias("ones"), (F.sum("n").over(whole) - total).alias("zeros"))
    best = found.groupBy("key").agg(F.max(F.struct("f1", "bin", "at", "ones", "zeros")).alias("best")).select("key", "best.*")
    return {r["key"]: (r["at"], r["zeros"], r["ones"]) for r in best.collect()}


def remainder(doc_id):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents with a label that are not held out, as hashed words: toxic, lang, order, held and ids. A fifth, by hash, is held back to set the cuts."""
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(remainder(F.col("doc_id")) != 2)
    # No text of a document that is held out is sent.
    texts = docs.select("doc_id", "text", "lang").filter(remainder(F.col("doc_id")) != 2)
    # Large tables are joined by sorting, and so are small ones: what is moved grows in proportion from the start.
    joined = texts.join(known.hint("merge"), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("doc_id", F.lit(11)).alias("order"), (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(5)) == 0).alias("held"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashed = Words()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = pa.array([hashed(t.as_py()).tobytes() for t in part.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in NAMES), ids], names=[*NAMES, "ids"])

    ship(docs.sparkSession)
    return joined.mapInArrow(run, "toxic int, lang string, order long, held boolean, ids binary")


def fit(docs: DataFrame, labels: DataFrame, most: int = SHARD // 2) -> Model | None:
    """A model from all labelled documents that are not held out; a shard that trains apart has about ``most`` of either label.

    A fifth of them, by hash, sets the cuts and is not trained on.
    """
    spark = docs.sparkSession
    found = cut(labelled(docs, labels), "toxicity-words")
    n = {(r["toxic"], r["held"]): r["count"] for r in found.groupBy("toxic", "held").count().collect()}
    if len({y for y, _ in n}) < 2:
        forget(spark, found)
        return None
    apart = all((y, False) in n for y in (0, 1))
    counts = tuple(n.get((y, False), 0) + (0 if apart else n.get((y, True), 0)) for y in (0, 1))
    shards = min(SHARDS, -(-sum(counts) // (2 * most)))
    own = found.filter("not held") if apart else found
    dealt = own.withColumn("shard", F.pmod("order", F.lit(shards)).cast("int")).select("shard", "toxic", "order", "ids")
    dealt = cut(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "order", "ids"), "toxicity-shards")
    model = train(dealt, counts)
    forget(spark, dealt)
    check = found.filter("held") if apart and all((y, True) in n for y in (0, 1)) else own
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                logits = np.clip(shared.value.logits([np.frombuffer(x.as_py(), np.int64) for x in part.column("ids")]), -40, 40)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("toxic"), pa.array(np.floor(logits * BINS).astype(np.int64))], names=["lang", "toxic", "bin"])

    scored = cut(check.select("lang", "toxic", "ids").mapInArrow(run, "lang string, toxic int, bin long"), "toxicity-cuts")
    at, *_ = best_cuts(scored.select(F.lit(0).alias("key"), "bin", "toxic"))[0]
    shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - at
    model.constant += shift
    for lang, (own_cut, zeros, ones) in sorted(best_cuts(scored.select(F.col("lang").alias("key"), "bin", "toxic")).items()):
        # A language with few rows of either label keeps the common cut.
        if min(zeros, ones) >= 20:
            model.thresholds[lang] = float(1 / (1 + np.exp(-(own_cut + shift))))
    forget(spark, found, scored)
    return model


def score(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """``columns`` of the documents and ``score``, for every whole text. Clashing names: an own column ``score`` is dropped."""
    columns = [c for c in columns if c != "score"]
    kept = docs.select(*columns, *([] if "text" in columns else ["text"]))
    if model is None:
        return kept.withColumn("score", F.lit(0.0)).select(*columns, "score")
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashed = shared.value, Words()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                values = model.score([hashed(t.as_py()) for t in part.column("text")])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(values, pa.float64())], names=[*columns, "score"])

    schema = kept.select(*columns).withColumn("score", F.lit(0.0).cast("double")).schema
    return kept.mapInArrow(run, schema)


def reject(docs: DataFrame, model: Model | None) -> DataFrame:
    """Documents below the cut of their language, with all their columns."""
    scored = score(docs.withColumnsRenamed({"score": "_score"}), model, docs.withColumnsRenamed({"score": "_score"}).columns)
    cut = F.lit(THRESHOLD)
    for lang, at in (model.thresholds if model else {}).items():
        cut = F.when(F.col("lang") == lang, F.lit(at)).otherwise(cut)
    return scored.filter(F.col("score") < cut).drop("score").withColumnsRenamed({"_score": "score"})


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
