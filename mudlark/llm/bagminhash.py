"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banded and verified.

A document is the multiset of its windows of five words (all its words where it has fewer). Each different
shingle of weight w runs Poisson processes over a dyadic hierarchy of weight levels, [0, 1), [1, 2), [2, 4), ...,
one process an interval whose rate is the interval's length; a point that falls on a level at or above w is
thinned out, so that heavier copies of a shingle extend what lighter ones have. Every point picks a register,
and a register keeps its earliest point: two documents agree in a register with the probability of their
weighted Jaccard similarity. A document's points are made up to a time by which its registers are
likely full, and on to twice that for the documents where one is not, so the work is near the register count.

``BANDS`` bands of ``WIDTH`` registers name buckets. Equal texts count as one text. In a bucket every text meets the
bucket's leader, its best connected member, so that copies meet what they were copied from. Verified pairs (similarity of
the multisets themselves, at least ``LIKE``) are closed to classes. Buckets that still hold several classes go through
further rounds: small ones compare all texts of different classes, in large ones all meet the ``LEADERS`` best connected
texts of other classes. What large buckets still hold of different classes is then compared in full: their members are
dealt into blocks of ``BLOCK`` texts, pairs of blocks are compared as matrices of shingle hashes, and only links come
out, at most one less than there are texts. So every two texts that share a bucket end in one class or were
compared. A pair of similarity 0.8 shares no bucket with probability 6e-5.

Edge cases: a null text counts as an empty one; texts without words are alike only when equal; a null doc_id
is kept; rows with equal ids but different texts are told apart by text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudlark.llm.common import cut, ship

BANDS, WIDTH, SHINGLE, LIKE = 32, 6, 5, 0.8
REGISTERS = BANDS * WIDTH
#: Texts up to which all pairs of different classes in a bucket are compared.
SMALL = 8
#: Leaders that the texts of a larger bucket are compared with in a round.
LEADERS = 4
#: Texts of a block of a large bucket, and columns of a matrix that are held at a time.
BLOCK, COLUMNS = 256, 4096
#: Rows up to which ids of texts are broadcast: 24 MB.
BROADCAST = 1_000_000
GAPS = {ord(c): " " for c in "\t\n\x0b\x0c\r"}

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def split(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(GAPS).split(" ") if w]


def shingles(words: list[str]) -> Counter:
    """The multiset of a text's windows, as tuples of words."""
    return Counter(zip(*(words[i:] for i in range(min(SHINGLE, len(words)))), strict=False)) if words else Counter()


class Hashes:
    """Shingle hashes of texts, with a memory for words that is emptied when it is full."""

    def __init__(self, most: int = 400_000):
        self.known: dict[str, int] = {}
        self.most = most

    def _new(self, word: str) -> int:
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Different shingles of a text and how often each occurs."""
        known, new = self.known, self._new
        w = np.array([known.get(x) or new(x) for x in split(text)], dtype=np.uint64)
        k = min(SHINGLE, len(w))
        h = np.full(len(w) - k + 1 if k else 0, k, np.uint64)
        for i in range(k):
            h = mix(h * U(0xD6E8FEB86659FD93) + w[i : i + len(h)])
        return np.unique(h, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """A row of registers for each multiset of (hashes, integer weights); none may be empty."""
    n = len(bags)
    owner = np.repeat(np.arange(n), [len(h) for h, _ in bags])
    element = np.concatenate([h for h, _ in bags])
    weight = np.concatenate([w for _, w in bags]).astype(np.int64)
    total = np.bincount(owner, weight, n)
    until = registers * (np.log(registers) + 3) / total
    # One process for each interval of the hierarchy that lies below the weight, at least in part.
    parts = []
    for level in range(int(weight.max()).bit_length() + 1):
        low = 0 if level == 0 else 1 << (level - 1)
        own = np.flatnonzero(weight > low)
        if not len(own):
            break
        parts.append((owner[own], mix(element[own] ^ U((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))), np.full(len(own), max(1, low), np.float64), weight[own] - low))
    who, seed, rate, height = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, made = np.zeros(len(who)), np.zeros(len(who), np.int64)
    best, value = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint32)
    while True:
        active = np.flatnonzero(time < until[who])
        while len(active):
            ahead = np.maximum(1, np.minimum(4096, (rate[active] * (until[who[active]] - time[active])).astype(np.int64) + 1))
            ends = np.cumsum(ahead)
            p = np.repeat(active, ahead)
            k = np.arange(ends[-1]) - np.repeat(ends - ahead, ahead) + made[p]
            r = mix(seed[p] + k.astype(np.uint64) * U(0xD1342543DE82EF95))
            gap = -np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[p]
            run = np.cumsum(gap)
            first = ends - ahead
            t = run - np.repeat(run[first] - gap[first], ahead) + time[p]
            time[active], made[active] = t[ends - 1], made[active] + ahead
            r = mix(r ^ U(0xA0761D6478BD642F))
            keep = t < np.repeat(until[who[active]], ahead)
            wide = np.flatnonzero(keep & (rate[p] > height[p]))
            if len(wide):
                level = (mix(r[wide] ^ U(0xE7037ED1A0B428DB)) >> U(11)).astype(np.float64) * 2.0**-53 * rate[p[wide]]
                keep[wide] = np.floor(level) < height[p[wide]]
            t, r, p = t[keep], r[keep], p[keep]
            slot = who[p] * registers + ((r >> U(32)) * U(registers) >> U(32)).astype(np.int64)
            np.minimum.at(best, slot, t)
            won = t == best[slot]
            value[slot[won]] = r[won].astype(np.uint32)
            active = active[time[active] < until[who[active]]]
        bare = np.isinf(best).reshape(n, registers).any(1)
        if not bare.any():
            return value.reshape(n, registers)
        until = np.where(bare, 2 * until, 0)


def buckets(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The bucket of each band, as signed 64-bit numbers."""
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for i in range(parts.shape[2]):
        key = mix(key * U(0xD6E8FEB86659FD93) + parts[:, :, i])
    return key.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, and ``keys``, the buckets of its bands (none for a text without words)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashes()
        for batch in batches:
            at, size, bags = 0, 0, []
            texts = batch.column("text")
            for k in range(batch.num_rows):
                bags.append(hashed(texts[k].as_py()))
                size += len(bags[-1][0])
                if size >= 60_000 or len(bags) >= 128 or k + 1 == batch.num_rows:
                    full = [i for i, (h, _) in enumerate(bags) if len(h)]
                    keys: list = [[] for _ in bags]
                    if full:
                        for i, row in zip(full, buckets(signatures([bags[i] for i in full])), strict=True):
                            keys[i] = row
                    part = batch.slice(at, len(bags))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "keys"])
                    at, size, bags = k + 1, 0, []

    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), "text")
    schema = rows.select("doc_id", "digest").withColumn("keys", F.array().cast("array<bigint>")).schema
    return rows.mapInArrow(run, schema)


def likeness(a: Counter, b: Counter) -> float:
    """The Jaccard similarity of two multisets; 0 for two empty ones."""
    if len(a) > len(b):
        a, b = b, a
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    whole = a.total() + b.total() - shared
    return shared / whole if whole else 0.0


def verify(pairs: DataFrame, texts: DataFrame, like: float = LIKE) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are alike, by their whole multisets."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, Counter()
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for i in range(batch.num_rows):
                a, b = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                if b != last:
                    last, held = b, shingles(split(batch.column("text_b")[i].as_py()))
                if likeness(shingles(split(batch.column("text_a")[i].as_py())), held) >= like:
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, name: str = "near") -> DataFrame:
    """(node, class) of every node with a link; a class is its smallest node. Labels spread and jump until they rest."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")), f"{name}-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("least"))
        spread = labels.join(seen, "node").select("node", F.col("class").alias("was"), F.least("class", "least").alias("class"))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("next"))
        after = cut(spread.join(jump, "class", "left").select("node", "was", F.coalesce("next", "class").alias("class")), f"{name}-labels")
        labels = after.select("node", "class")
        if after.filter("was <> class").isEmpty():
            return labels


def tokens(texts: DataFrame) -> DataFrame:
    """node and ``tokens``: a hash for each occurrence of a shingle, the k-th of equal ones by itself."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, found = batch.slice(at, 256), []
                for text in part.column("text").to_pylist():
                    h, n = hashed(text)
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found.append(mix(np.repeat(h, n) + nth.astype(np.uint64) * U(0xD6E8FEB86659FD93)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "tokens"])

    return texts.select("node", "text").mapInArrow(run, "node long, tokens array<long>")


def alike(a: list[np.ndarray], b: list[np.ndarray], like: float = LIKE) -> np.ndarray:
    """Which texts of ``a`` are alike to which of ``b``, by their tokens."""
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    # A token of one text adds to no pair.
    number = np.cumsum(times > 1) - 1
    use = times[column] > 1
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(a), len(b)), np.float64)
    width = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, COLUMNS):
        x, y = np.searchsorted(column, (low, low + COLUMNS))
        m = np.zeros((len(a) + len(b), COLUMNS), np.float32)
        m[owner[x:y], column[x:y] - low] = 1
        shared += m[: len(a)] @ m[len(a) :].T
    size = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    return shared / np.maximum(size - shared, 1) >= like


def compare_blocks(rest: DataFrame, texts: DataFrame, like: float = LIKE) -> DataFrame:
    """(bucket, node, class) -> pairs (a, b) of alike texts of a bucket that join all its classes that have some."""
    ship(rest.sparkSession)
    blocks = F.ceil(F.col("texts") / BLOCK).cast("int")
    sized = rest.groupBy("bucket").agg(F.count("*").alias("texts"))
    own = rest.join(sized, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    # Block i meets block j in the group (i, j), i <= j.
    met = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    own = own.select("bucket", "node", "class", "block", met).select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            up: dict[int, int] = {r[2]: r[2] for r in rows}

            def find(x: int) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            a = [r for r in rows if r[0][3] == r[0][1]]
            b = [r for r in rows if r[0][3] == r[0][2]]
            out: tuple[list, list] = ([], [])
            if len(up) > 1 and a and b:
                for k in range(0, len(a), BLOCK):
                    for m in range(0, len(b), BLOCK):
                        left, right = a[k : k + BLOCK], b[m : m + BLOCK]
                        ca, cb = np.array([r[2] for r in left]), np.array([r[2] for r in right])
                        if ca.min() == ca.max() == cb.min() == cb.max():
                            continue
                        hit = alike([r[3] for r in left], [r[3] for r in right], like) & (ca[:, None] != cb[None, :])
                        for x, y in zip(*np.nonzero(hit), strict=True):
                            p, q = find(left[x][2]), find(right[y][2])
                            if p != q:
                                up[p] = q
                                out[0].append(left[x][1])
                                out[1].append(right[y][1])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

        rows: list[tuple] = []
        for batch in batches:
            lists = batch.column("tokens")
            for n, (bucket, i, j, block, node, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "block", "node", "class")), strict=True)):
                if rows and rows[-1][0][:3] != (bucket, i, j):
                    yield flush(rows)
                    rows = []
                rows.append(((bucket, i, j, block), node, label, lists[n].values.to_numpy()))
        if rows:
            yield flush(rows)

    hashed = cut(tokens(texts.join(rest.select("node").distinct(), "node")), "near-tokens")
    dealt = own.join(hashed, "node").repartition("group").sortWithinPartitions("bucket", "i", "j", "node")
    return dealt.select("bucket", "i", "j", "block", "node", "class", "tokens").mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, like: float = LIKE, rounds: int = 4) -> DataFrame:
    """(doc_id, digest, class_id) of every document: the smallest id among the documents of its class."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    signed = cut(sign(docs), "near-signed")
    # One row a text: copies of it end here, whatever their number.
    nodes = cut(
        signed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()),
        "near-nodes",
    )
    banded = nodes.select("node", F.explode("keys").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("texts")).filter("texts > 1")
    paired = cut(banded.join(shared, "bucket"), "near-paired")
    # The text that others were copied from shares more buckets, and fuller ones, than its copies share with
    # each other: the leaders of a bucket are its members with the most neighbours.
    degrees = paired.groupBy("node").agg(F.sum("texts").alias("degree"))
    members = paired.join(degrees, "node").withColumn("rank", F.struct("degree", F.xxhash64("node").alias("lot"), F.col("node").alias("node")))
    members = cut(members, "near-members")
    leads = members.groupBy("bucket").agg(F.max("rank").alias("lead")).select("bucket", F.col("lead.node").alias("lead"))

    wanted = members.select("node").distinct().join(nodes.select("node", "first", "digest"), "node")
    n = wanted.count()
    if n == 0:
        labels = None
    else:
        own = docs.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
        ids = wanted.select("node", F.col("first").alias("_first"), F.col("digest").alias("_digest"))
        held = own.join(F.broadcast(ids) if n <= BROADCAST else ids, own["doc_id"].eqNullSafe(ids["_first"]) & (own["digest"] == ids["_digest"]))
        texts = cut(held.select("node", "text").dropDuplicates(["node"]), "near-texts")
        tried = cut(members.select("bucket", "node").join(leads, "bucket").filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), "near-pairs")
        links = cut(verify(tried, texts, like), "near-found")
        labels = components(links)
        for _ in range(rounds):
            known = members.select("bucket", "node", "rank").join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
            # The best connected texts of a bucket, one of each part that a hash deals its members into.
            top = [F.max(F.when(F.pmod(F.col("rank.lot"), F.lit(LEADERS)) == j, F.struct("rank", "class"))) for j in range(LEADERS)]
            several = known.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("texts"), F.array_compact(F.array(*top)).alias("tops")).filter("low <> high").drop("low", "high")
            rest = cut(known.join(several, "bucket").drop("rank"), "near-rest")
            few, many = rest.filter(F.col("texts") <= SMALL), rest.filter(F.col("texts") > SMALL)
            each = few.select("bucket", F.col("node").alias("a"), F.col("class").alias("class_a")).join(few.select("bucket", F.col("node").alias("b"), F.col("class").alias("class_b")), "bucket").filter("class_a < class_b")
            wide = many.select(F.col("node").alias("a"), F.explode(F.filter("tops", lambda t: t["class"] != F.col("class"))).alias("t")).select("a", F.col("t.rank.node").alias("b"))
            pairs = each.select("a", "b").union(wide).distinct()
            done = tried.union(tried.select("b", "a"))
            pairs = cut(pairs.join(done, ["a", "b"], "left_anti"), "near-pairs")
            if pairs.isEmpty():
                break
            new = cut(verify(pairs, texts, like), "near-found")
            if new.isEmpty():
                break
            tried, links = tried.union(pairs), links.union(new)
            labels = components(links)
        # Small buckets are done; in large ones every two texts of different classes are compared.
        known = members.select("bucket", "node").join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
        mixed = known.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("texts")).filter((F.col("low") != F.col("high")) & (F.col("texts") > SMALL)).select("bucket")
        rest = cut(known.join(mixed, "bucket"), "near-rest")
        if not rest.isEmpty():
            new = cut(verify(cut(compare_blocks(rest, texts, like), "near-pairs"), texts, like), "near-found")
            if not new.isEmpty():
                labels = components(links.union(new))
    if labels is not None:
        nodes = nodes.join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
    else:
        nodes = nodes.withColumn("class", F.col("node"))
    # A class is named by the smallest id of its documents.
    named = cut(nodes.select("digest", "class", "first"), "near-classes")
    heads = named.groupBy("class").agg(F.min("first").alias("class_id"))
    texts_of = named.join(heads, "class").select("digest", "class_id")
    return signed.select("doc_id", "digest").join(texts_of, "digest").select("doc_id", "digest", "class_id")


def keep_one(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """One document of each class, the one with the smallest id, with all columns of ``docs``."""
    names = docs.columns
    found = classes(docs, like).groupBy("class_id").agg(F.min(F.struct("doc_id", "digest")).alias("best")).select(F.col("best.doc_id").alias("_id"), F.col("best.digest").alias("_digest"))
    held = docs.withColumn("_own", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    kept = held.join(found, held["doc_id"].eqNullSafe(found["_id"]) & (held["_own"] == found["_digest"]))
    # Rows that repeat in id and text are one document.
    return kept.dropDuplicates(["_id", "_digest"]).select(*names)


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")
