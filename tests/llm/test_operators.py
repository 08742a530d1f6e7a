"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mudlark.llm import bagminhash, chat_format, common, media, mixing, quality, sentencepiece_lattice, sharding, suffix_dedup, toxicity, warc
from mudlark.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, size string"


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(120)
    base = prose(200)
    texts = [None, "", "  \n\t ", "ä", "x" * 900, passage, f"{prose(30)}\n{passage}\n{prose(20)}", f"{prose(10)} {passage} {prose(5)} {passage}", prose(4000)]
    texts += [base] * 4
    for k in range(6):
        w = base.split(" ")
        for _ in range(k):
            w[rng.randrange(len(w))] = "zzz"
        texts.append(" ".join(w))
    texts += [prose(rng.randint(1, 300)) for _ in range(25)]
    texts += ["Zeile eins zwei\n" * 8 + prose(60), "日本語 テキスト 😀 " * 40, "### $$$ %% " * 30]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "b", "a", "b", "ü"][i % 5], 0, "s", "t", "u") for i, t in enumerate(texts)]
    return rows + [rows[9], rows[6]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    size = defaultdict(int)
    for _, t, _, s, *_ in corpus():
        size[s] += len(words_of(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, capped = {}, set()
    total = 1.5 * sum(size.values())
    while True:
        left = total - sum(2 * size[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]}
        if not over:
            want = {s: 2.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in open_) for s in order}
            break
        capped |= over
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in order:
        assert abs(taken[s] - want[s]) <= 30, s
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0


def test_suffix_dedup(docs, empty, monkeypatch):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    for _, raw in raws:
        seen.update(raw[k : k + 400] for k in range(len(raw) - 399))
    want = []
    for i, raw in raws:
        mask = np.zeros(len(raw) + 1, np.int8)
        for k in range(len(raw) - 399):
            if seen[raw[k : k + 400]] > 1:
                mask[k : k + 400] = 1
        starts = int((np.diff(np.concatenate([[0], mask])) == 1).sum())
        left = bytes(b for b, m in zip(raw, mask, strict=False) if not m)
        want.append((i, len(raw), int(mask.sum()), starts, hashlib.sha256(left).hexdigest()))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for hot in (512, 1):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        assert sorted(map(tuple, suffix_dedup.results(docs).select(columns).collect())) == sorted(want)
    out = suffix_dedup.dedup(docs)
    assert out.columns == docs.columns and out.count() == len(want)
    assert suffix_dedup.results(empty).count() == 0
    # Words in passages of 51 words that also start elsewhere.
    seen = Counter()
    for _, t, *_ in corpus():
        w = words_of(t)
        seen.update(tuple(w[k : k + 51]) for k in range(len(w) - 50))
    passages = []
    for i, t, *_ in corpus():
        w = words_of(t)
        passages.append((i, len({k + j for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for j in range(51)})))
    both = suffix_dedup.results(docs, with_words=True)
    assert sorted(map(tuple, both.select(columns).collect())) == sorted(want)
    assert sorted(map(tuple, both.select("doc_id", "n_passage_words").collect())) == sorted(passages)


def test_word_hashes():
    texts = [" a  bb\ta\nbb ", "", " ", "x", "ä bb " + "y" * 500 + " a", "a"]
    raw = lambda t: np.frombuffer(t.encode(), np.uint8)
    by_word = {}
    for t in texts:
        for piece in (1 << 18, 100, 3):
            h = suffix_dedup.word_hashes(raw(t), piece)
            assert len(h) == len(words_of(t))
            for w, x in zip(words_of(t), h.tolist(), strict=True):
                by_word.setdefault((len(w.encode()) > piece, w), set()).add(x)
    assert all(len(x) == 1 for x in by_word.values()) and len({min(x) for (far, _), x in by_word.items() if not far}) == 5


def test_stage_cuts_passages_of_51_words(spark, monkeypatch):
    """Against brute force: passages of 51 words go though they have fewer than 400 bytes, those of 50 words stay."""
    import corpus_pipeline

    rng = random.Random(11)
    prose = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(1000)}" for _ in range(n)]
    short, long, most = prose(50), prose(51), prose(55)
    assert len(" ".join(most)) < 400
    texts = [prose(20) + x + prose(20) for x in (short, long, most) for _ in range(3)] + [prose(80), long + prose(9), prose(9) + most, long, most]
    texts = [(["\t", " ", "\n\n"][i % 3]).join(t) for i, t in enumerate(texts)] + [None, "", " \n "]
    seen = Counter()
    for t in texts:
        w = words_of(t)
        seen.update(tuple(w[k : k + 51]) for k in range(len(w) - 50))
    want = []
    for i, t in enumerate(texts):
        w = words_of(t)
        gone = {k + j for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for j in range(51)}
        want.append((i, [x for k, x in enumerate(w) if k not in gone]))
    frame = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for hot in (512, 1):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        rows = corpus_pipeline.cut_repeats(spark, frame, "").collect()
        assert sorted((r["doc_id"], words_of(r["text"])) for r in rows) == want
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    assert [n for _, n in want[:3]] != [[]] * 3 and not want[12][1]


def test_suffix_sort():
    rng = random.Random(3)
    data = [bytes(rng.choice(b"ab") for _ in range(700)) for _ in range(3)]
    data += [data[0][:500] + b"c" * 100, b"a" * 700]
    suffixes = suffix_dedup.Suffixes(np.frombuffer(b"".join(data), np.uint8), 50)
    at = np.array([k for k in range(0, 3000)])
    raw = b"".join(data)
    order = suffixes.sort(at, np.zeros(len(at), np.int64))
    assert [raw[at[i] : at[i] + 50] for i in order] == sorted(raw[k : k + 50] for k in at)
    x, y = np.array([0, 5, 2700]), np.array([2100, 9, 2701])
    n = suffixes.extension(x, y)
    for a, b, k in zip(x, y, n, strict=True):
        assert raw[a : a + k] == raw[b : b + k] and (k == 50 or raw[a + k] != raw[b + k])
    flags = suffix_dedup.repeated([raw[:600], raw[2100:2700]], [200, 200], [201, 201], [0, 0])
    assert flags[0].sum() == 101 and flags[1].sum() == 101


def test_pieces_of_long_texts():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    whole, parts = suffix_dedup.runs(raw), suffix_dedup.runs(raw, piece=700)
    at = lambda r: np.repeat(r[1], np.diff(np.append(r[0], 4601)))
    assert (at(whole) == at(parts)).all() and len(parts[0]) >= len(whole[0])


def test_sharding(docs, empty):
    rows = sharding.shard(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.shard(empty).count() == 0


def test_sharding_keeps_groups(spark):
    rows = [(i, f"t{i % 100}" if i < 500 else f"u{i}") for i in range(2000)] + [(5000 + i, "hot") for i in range(1000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and out.groupby("shard").slot.nunique().equals(sizes)
    hot = out[out.doc_id >= 5000]
    # A third of all rows can't be in one shard; they gather beyond the even spread that hashing gives.
    assert (hot.groupby("shard").size() ** 2).sum() / 1000**2 >= 2 / 24
    split = out[(out.doc_id < 500)].assign(t=lambda d: d.doc_id % 100).groupby("t").shard.nunique()
    assert (split == 1).mean() >= 0.9


def test_quality(docs, empty):
    rows = {(r["doc_id"]): r for r in quality.judge(docs).collect()}
    for i, t, *_ in corpus():
        ws = words_of(t)
        spans = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        covered = {k + j for k in range(len(ws) - 2) if spans[tuple(ws[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = rows[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, (i, t)
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r["base_failed"] or not r["kept"])
        assert all(r[c] is None or 0 <= r[c] <= 1 for c in ("char_distance", "word_distance"))
    assert quality.judge(empty).count() == 0


def test_quality_verdicts(spark):
    """All verdicts against a plain version; other languages, word salad and junk go, all else stays."""
    rng = random.Random(9)
    own = {"en": "the of and to in that was for".split(), "de": "der die und den von das mit nicht".split()}
    other = {x: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(400)] for x in own}
    prose = lambda x, n: " ".join(rng.choice(own[x]) if rng.random() < 0.4 else rng.choice(other[x]) for _ in range(n))
    rows = [(i, prose("en" if i % 2 else "de", rng.randint(60, 400)), "en" if i % 2 else "de") for i in range(200)]
    rows += [(1000 + i, prose("de", 300), "en") for i in range(5)] + [(1100 + i, " ".join(rng.choice(other["en"]) for _ in range(300)), "en") for i in range(5)]
    rows += [(1200, "### 12345 @@@@ 77777 ~~~~ " * 40 + prose("en", 60), "en"), (1201, prose("en", 300), "xx"), (1202, prose("de", 60), "en"), (1203, None, None)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    def counts(t):
        t = t or ""
        chars = [len(re.sub(p.replace(r"\p{Ll}", "a-z").replace(r"\p{Lu}", "A-Z").replace(r"\p{Nd}", "0-9"), "", t)) for p in quality.CLASSES.values()]
        words = [w.lower() for w in words_of(t)]
        commons = [words.count(c) for c in quality.COMMON]
        return [*chars, len(t) - sum(chars)], [*commons, len(words) - sum(commons)]

    def distance(p, q):
        a, b = np.array(p) / sum(p), np.array(q)
        m = (a + b) / 2
        kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m, strict=True) if v)
        return np.sqrt(max(0, (kl(a) + kl(b)) / 2))

    both = {i: counts(t) for i, t, _ in rows}
    good = [(i, lang) for i, _, lang in rows if not got[i]["base_failed"]]
    share = lambda ids, k: np.sum([both[i][k] for i in ids], 0) / np.sum([both[i][k] for i in ids])
    pooled = [share([i for i, _ in good], k) for k in (0, 1)]
    known = {x: [share([i for i, lang in good if lang == x], k) for k in (0, 1)] for x in own}
    for i, t, lang in rows:
        chars, commons = known.get(lang, pooled)
        n = len(words_of(t))
        top = distance([0] * len(quality.COMMON) + [1], commons) * (0.75 + 0.25 * np.sqrt(75 / max(1, n)))
        odd = got[i]["word_chars"] >= 200 and distance(both[i][0], chars) > 0.25 or n >= 75 and distance(both[i][1], commons) > top
        assert got[i]["kept"] == (not got[i]["base_failed"] and not odd), i
    gone = {i for i, r in got.items() if not r["kept"]}
    assert gone == {*range(1000, 1005), *range(1100, 1105), 1200, 1203}


def test_divergence(spark):
    p, q = [3, 0, 5], [0.5, 0.25, 0.25]
    got = spark.createDataFrame([(p,)], "c array<int>").select(quality._distance(F.col("c"), F.array(*[F.lit(x) for x in q])).alias("d")).first()["d"]
    a, b = np.array(p) / 8, np.array(q)
    m = (a + b) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m, strict=True) if v)
    assert got == pytest.approx(np.sqrt((kl(a) + kl(b)) / 2))


def test_warc(spark):
    html = ["<p>" + "a" * 200, "<p>" + "a" * 200, "", None, "short", "short", "<p>" + "b" * 100, "<p>" + "a" * 200, "ü" * 60, "ü" * 60]
    rows = [(i * 3 % 10, f"http://x/{i}", h, "x") for i, h in enumerate(html)] + [(None, None, "<p>" + "b" * 100, "x"), (0, "http://x/0", html[0], "x")]
    path = scratch(spark, "t-warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"), "digest"), path)
    back = warc.parse(warc.read(spark, path)).collect()
    assert len(back) == len(rows) and spark.read.parquet(f"{path}/payloads").count() == 5
    first = defaultdict(lambda: 1 << 63)
    for i, _, h, _ in rows:
        first[h or ""] = min(first[h or ""], 1 << 62 if i is None else i)
    want = Counter()
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and i != first[h or ""]
        want[i, "revisit" if again else "response", first[h or ""] if again else None, hashlib.sha256(raw).hexdigest()] += 1
    assert Counter((r["page_id"], r["said_type"], r["refers_to"], r["said_digest"]) for r in back) == want
    for r in back:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n") and len(rest) - 4 == r["said_length"]
        if r["said_type"] == "response":
            assert hashlib.sha256(rest[:-4]).hexdigest() == r["said_digest"]
    out = warc.export(spark, path, scratch(spark, "t-export")).agg(F.sum("records")).first()[0]
    assert out == len(rows)


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(1)
    element = bagminhash.mix(np.arange(300, dtype=np.uint64))
    for most in (2, 9):
        a = rng.integers(0, most, 300)
        b = np.maximum(0, a + rng.integers(-1, 2, 300) * (rng.random(300) < 0.4))
        s = bagminhash.signatures([(element[a > 0], a[a > 0]), (element[b > 0], b[b > 0])], 4096)
        assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_near_duplicates(docs, empty):
    rows = corpus()
    bags = [bagminhash.shingles(words_of(t)) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or bagminhash.likeness(bags[a], bags[b]) >= 0.8:
                up[find(a)] = find(b)
    lowest = defaultdict(lambda: 10**9)
    for k, r in enumerate(rows):
        lowest[find(k)] = min(lowest[find(k)], r[0])
    got = bagminhash.classes(docs).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted((r[0], lowest[find(k)]) for k, r in enumerate(rows))
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(lowest.values())
    assert bagminhash.classes(empty).count() == 0


def test_near_duplicates_in_a_large_group(spark):
    """Copies that are alike to their origin, and not all to each other, end in its class."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        w = list(base)
        for k in rng.sample(range(300), 5):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    alike = [bagminhash.likeness(bagminhash.shingles(rows[0][1].split()), bagminhash.shingles(t.split())) >= 0.8 for _, t in rows[1:]]
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(alike) > 250 and all(got[i] == 0 for i, ok in enumerate(alike, 1) if ok)


@pytest.mark.parametrize("block", [256, 40])
def test_near_duplicates_without_an_origin(spark, monkeypatch, block):
    """Couples of like texts in a large group that has no text they all are alike to: the classes of brute force."""
    monkeypatch.setattr(bagminhash, "BLOCK", block, raising=False)
    monkeypatch.setattr(bagminhash, "COLUMNS", 100, raising=False)
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]

    def changed(words, n):
        out = list(words)
        for k in rng.sample(range(300), n):
            out[k] = f"x{rng.random()}"
        return out

    rows = []
    for _ in range(160):
        one = changed(base, 5)
        rows += [(len(rows) + k, " ".join(changed(one, 3))) for k in range(2)]
    bags = [bagminhash.shingles(t.split()) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bagminhash.likeness(bags[a], bags[b]) >= 0.8:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: find(i) for i in range(len(rows))}
    assert 100 < len(set(want.values())) < 200
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_stages_give_memory_back(spark, monkeypatch):
    """Every stage of the pipeline collects the executors' heaps first, and a run's first body drops what a worker kept of others."""
    import corpus_pipeline

    common.settle(spark)
    common.KEPT["other"] = object()
    common.release()
    assert not common.KEPT

    def stop(session):
        raise InterruptedError

    monkeypatch.setattr(corpus_pipeline, "settle", stop)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(InterruptedError):
            stage(spark, None, "")


def test_driver_gives_memory_back(spark, docs, monkeypatch):
    """The driver's JVM gives memory back before every stage, and between the steps of the suffix stage."""
    assert "native heap" in common.trim(spark).lower()
    asked = []
    monkeypatch.setattr(common, "trim", lambda s: asked.append("settle"))
    monkeypatch.setattr(suffix_dedup, "trim", lambda s: asked.append("suffix"))
    common.settle(spark)
    suffix_dedup.dedup_words(docs)
    assert asked == ["settle"] + ["suffix"] * 3


def test_suffix_ids_by_shuffle(docs, monkeypatch):
    """Ids of texts are broadcast up to a bound that a driver of 750 MB of heap can hold twice; more are joined by shuffles, with equal results."""
    assert suffix_dedup.BROADCAST * 256 <= 32 << 20
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]
    found = lambda: Counter(tuple(r) for r in suffix_dedup.results(docs, with_words=True).select(*columns).collect())
    want = found()
    monkeypatch.setattr(suffix_dedup, "BROADCAST", 0)
    assert found() == want and any(r[2] for r in want)


def test_toxicity(spark, empty):
    rng = random.Random(4)
    rude = ["grumblethorp", "snarkle", "vexoid"]
    words = [f"word{k}" for k in range(2000)]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 7 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(rude))
        rows.append((i, " ".join(w), "en", i))
        if i % 2 == 0 or bad:
            labels.append((i, 1, int(bad)))
    rows += [(9001, None, None, 1), (9002, "", "xx", 1), (9003, "snarkle " * 70_000, "en", 1), (None, "word1", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    known = spark.createDataFrame([*labels, (9002, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known, most=600)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, ["doc_id", "lang"]).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i]["score"] >= 0.3) == (i % 7 == 0) for i in held)
    assert right / len(held) > 0.95 and got[9003]["score"] > 0.3 > got[9001]["score"] == got[9002]["score"]
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id = 9003").count() == 0 and kept.filter("doc_id = 9002").count() == 1
    none = toxicity.fit(docs, known.filter("toxic = 0"))
    assert none is None and {r["score"] for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0


def test_toxicity_learns_from_all(spark):
    """Words of toxic texts that a sample of ``most`` rows would seldom hold are learnt, and no toxic text is cut off by them."""
    rng = random.Random(6)
    words = [f"word{k}" for k in range(500)]
    rude = ["".join(rng.choice("bcdfgklmnprstvz") for _ in range(8)) for _ in range(100)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12)) + (f" {rude[i // 3 % 100]}" if i % 3 == 0 else ""), "en") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(6000)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, most=150), ["doc_id"]).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == (i % 3 == 0) for i in held) / len(held) > 0.95


def test_toxicity_one_join(spark):
    """Small labels are joined as large ones are, not sent to all executors."""
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = toxicity.labelled(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_toxicity_small_moments(spark):
    """Second moments that fade become neither negative nor zero when shards are put together, or the next pass divides by nothing."""
    trainer = toxicity.Trainer()
    trainer.model.constant, start = -100.0, 3.6 / 2**32
    trainer.dense[0].v[:] = start
    ids = np.array([toxicity.Words()("word")[0]] * 3, np.int64).tobytes()
    rows = spark.createDataFrame([(s, 0, ids) for s in range(4) for _ in range(3200)], "shard int, toxic int, ids binary")
    rows = rows.repartition(4, "shard").sortWithinPartitions("shard")
    found = toxicity._round(rows, (12_800, 0), trainer, 0)
    assert np.allclose(found.dense[0].v, start * 0.99**100, rtol=1e-3, atol=0) and abs(found.dense[0].t - 100) < 1e-3
    assert np.isfinite(toxicity._round(rows, (12_800, 0), found, 1).flat()).all()


def test_toxicity_sums(spark):
    """Sums of any size, whose order is that of the bytes: the same in any order of the rows."""
    rng = np.random.default_rng(3)
    table, dense = 5, (2 << toxicity.BITS) + 1
    rows = [(at, (rng.normal(0, 1, 16) * 10.0 ** rng.integers(-12, 13)).astype(np.float32)) for at in (table, dense) for _ in range(3000)]
    rows += [(k, np.full(16, k, np.float32)) for k in range(10, 40)]
    got = []
    for _ in range(2):
        rng.shuffle(rows := [(int(at), x) for at, x in rows])
        found = toxicity.summed(spark.createDataFrame([(at, x.tobytes()) for at, x in rows], "at long, raw binary")).collect()
        got.append({r["at"]: bytes(r["raw"]) for r in found})
        assert len(found) == len(got[-1]) == 32
    assert got[0] == got[1]
    for at, raw in got[0].items():
        own = np.array([x for a, x in rows if a == at], np.float64)
        assert np.allclose(np.frombuffer(raw, np.float32), own.sum(0) if at == dense else own.mean(0), rtol=1e-5)


def test_toxicity_cuts(spark):
    """The cut of a key is the best of all cuts between its rows, whatever their number."""
    rng = random.Random(8)
    rows = [(k, rng.randrange(-40, 40) + 20 * y, y) for k in ("a", "b") for y in (rng.random() < 0.2 for _ in range(400))]
    rows = [(k, b, int(y)) for k, b, y in rows] + [("c", 5, 1)]
    got = toxicity.best_cuts(spark.createDataFrame(rows, "key string, bin long, toxic int"))
    for key in "abc":
        own = [(b, y) for k, b, y in rows if k == key]
        f1 = lambda at: 2 * sum(y for b, y in own if b / 1024 >= at) / (sum(b / 1024 >= at for b, _ in own) + sum(y for _, y in own))  # noqa: E731, B023
        at, zeros, ones = got[key]
        assert f1(at) == max(f1(b / 1024) for b, _ in own) and (zeros, ones) == (sum(y == 0 for _, y in own), sum(y for _, y in own))


def test_toxicity_pieces():
    model = toxicity.Model.fresh()
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 1 << 34, 150_000)
    whole = np.concatenate(model.maps(np.concatenate([model.rows(ids), np.zeros((2, 16), np.float32), np.zeros((2, 16), np.float32)])), axis=1)[:-2].max(0)
    assert np.allclose(model.pooled([ids])[0], np.maximum(whole, model.pooled([ids])[0].min()), atol=1e-4)


def test_media(docs, empty, spark):
    path = scratch(spark, "t-media")
    media.store(docs, path)
    rows = media.load(spark, path).collect()
    want = Counter()
    for i, t, *_ in corpus():
        raw = (t or "").encode()
        want[i, len(raw), media.padded(raw)] += 1
    assert Counter((int(r["key"]), r["n_bytes"], bytes(r["payload"])) for r in rows) == want
    by = defaultdict(set)
    for r in rows:
        by[r["payload_sha256"], r["n_bytes"]].add((r["media_sha256"], r["feature"], r["tail_crc32"]))
        assert r["payload_bytes"] % 64 == 0 < r["payload_bytes"] and r["tail_crc32"] == zlib.crc32(bytes(r["payload"])[-64:])
    assert all(len(x) == 1 for x in by.values())
    path = scratch(spark, "t-media")
    media.store(empty, path)
    assert media.load(spark, path, digest=True).count() == 0


def test_media_retries(spark, tmp_path, monkeypatch):
    """A block that is read wrong is read again by its offset; a member that is broken on disk is an error that names it."""
    path = f"file://{tmp_path}/a"
    media.store(spark.createDataFrame([(i, f"text {i} " * 50) for i in range(20)], "doc_id long, text string").coalesce(1), path)
    reader = media.ArchiveReader(path, True)
    parts = reader.partitions()
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 20
    info = next(iter(media.zipfile.ZipFile(next((tmp_path / "a").glob("*.zip"))).infolist()))
    store, root = media.files(path)
    name = f"{root}/{parts[0].name}"
    assert reader.member(store, name, info, b"broken")[2] == len("text 0 " * 50)
    file = tmp_path / "a" / parts[0].name
    raw = bytearray(file.read_bytes())
    raw[info.header_offset + 80] ^= 1
    file.write_bytes(raw)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    with pytest.raises(OSError, match="member at 0"):
        list(reader.read(parts[0]))


def test_ranges_read_each_member_once(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/a"
    media.store(spark.createDataFrame([(i, str(random.Random(i).random()) * 30) for i in range(200)], "doc_id long, text string").coalesce(1), path)
    monkeypatch.setattr(media, "RANGE_BYTES", 3000)
    reader = media.ArchiveReader(path, True)
    parts = reader.partitions()
    keys = [k for p in parts for b in reader.read(p) for k in b.column("key").to_pylist()]
    assert len(parts) > 5 and sorted(map(int, keys)) == list(range(200))


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The model file with unigram as its type and scores like log-probabilities, on a grid that single precision sums exactly."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(sentencepiece_lattice.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    rng = random.Random(1)
    plain = [p for p in m.pieces if p.type == 1]
    for k, p in enumerate(plain):
        p.score = -round(1024 * (3 + 9 * k / len(plain) + 2 * rng.random())) / 1024
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path), sentencepiece.SentencePieceProcessor(model_file=str(path))


STRANGE = [(100, "x" * 900), (101, "ab" * 700 + " \U0001F600" * 3), (102, " a  b "), (103, "12_34 ²½ x²y"), (104, "trail "), (105, "\n\n")]


def test_sentencepiece_is_the_library(spark, docs, empty, unigram, monkeypatch):
    path, library = unigram
    rows = [r for r in corpus() if len(r[1] or "") < 3000]
    table = spark.createDataFrame([r[:2] for r in rows] + STRANGE, "doc_id long, text string")
    want = Counter((i, t or "", tuple(library.encode(t or ""))) for i, t in [r[:2] for r in rows] + STRANGE)
    for block, hot in ((256, 48 << 20), (7, 3000)):
        monkeypatch.setattr(sentencepiece_lattice, "BLOCK", block)
        monkeypatch.setattr(sentencepiece_lattice, "HOT_BYTES", hot)
        assert Counter((r["doc_id"], r["text"] or "", tuple(r["ids"])) for r in sentencepiece_lattice.encode(table, path).collect()) == want
    assert sentencepiece_lattice.encode(empty, path).count() == 0


def test_sentencepiece_apart():
    """The short way for letters and what follows them finds the pattern's units."""
    rng = random.Random(2)
    into, apart = sentencepiece_lattice.splitter("letters")
    assert into("Wort, 12") == ["Wort,", "12"]
    signs = [*map(chr, range(33, 127)), *"\n\täß²½٣ⅷ日»…▁\U0001F600"]
    words = ["".join(rng.choice("aé日" if rng.random() < 0.6 else signs) for _ in range(rng.randint(0, 8))) for _ in range(20_000)]
    for w in [*words, *(w + rng.choice(signs) for w in ("a", "wort", "Äö")), "", "a", "a.", "a.\n", "▁a."]:
        assert apart(w) == sentencepiece_lattice.LETTERS.findall(w if w.startswith("▁") else "▁" + w), w


def test_sentencepiece_plain_words(monkeypatch):
    """Words of ASCII are cut without the long pattern, into its units; the encoder finds and uses units that aren't broadcast, alone or among others."""
    _, apart = sentencepiece_lattice.splitter("letters")
    words = ["it's", "a.\nB", "(x)", "12a", "_", ".", "x1y2", "a\tb", "wort", "wort."]
    want = [sentencepiece_lattice.LETTERS.findall("▁" + w) for w in words]
    monkeypatch.setattr(sentencepiece_lattice, "LETTERS", None)
    assert [apart(w) for w in words] == want
    units = sorted({u for x in want for u in x})
    ids = {u: np.array([k, k + 1], np.int32).tobytes() for k, u in enumerate(units)}
    for kept in (units, units[::2], []):
        encoder = sentencepiece_lattice.Encoder("letters", {u: ids[u] for u in kept})
        rest = set(units) - set(kept)
        for _ in range(2):
            assert encoder.rare(" ".join(words)) == rest and encoder.rare(None) == set()
            assert encoder.encode(" ".join(words), {u: ids[u] for u in rest}) == b"".join(ids[u] for x in want for u in x)


def best_sum(form, pieces):
    """The largest sum of scores over all ways to cut a form, and the ids of one such way: plain dynamic programming."""
    known = {t: (i, s) for t, i, s in pieces.table}
    best = [(0, [])]
    for end in range(1, len(form) + 1):
        here = None
        for start in range(max(0, end - pieces.longest), end):
            i, s = known.get(form[start:end], (None, None))
            if i is None and end - start > 1:
                continue
            total = best[start][0] + (pieces.unknown if i is None else s)
            if here is None or total > here[0]:
                here = (total, best[start][1] + ([i] if i is not None else [pieces.byte_ids[b] for b in form[start:end].encode()]))
        best.append(here)
    return best[-1][1]


def test_sentencepiece(spark, docs, empty):
    pieces = sentencepiece_lattice.Pieces.load()
    texts = [r[:2] for r in corpus() if len(r[1] or "") < 3000] + STRANGE
    table = spark.createDataFrame(texts, "doc_id long, text string")
    rows = sentencepiece_lattice.encode(table).persist()
    want = Counter((i, t, tuple(best_sum("▁" + t.replace(" ", "▁"), pieces)) if t else ()) for i, t in texts)
    assert Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in rows.collect()) == want
    assert Counter(map(tuple, sentencepiece_lattice.decode(rows).collect())) == Counter((i, t or "") for i, t in texts)
    short = sentencepiece_lattice.summary(table, with_ids=True).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in short) == Counter((i, ids) for i, _, ids in want.elements())
    assert all(r["exact"] and r["n_pieces"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], np.int32).tobytes()).hexdigest() for r in short)
    odd = spark.createDataFrame([(None, "a▁b"), (1, "a b")], "doc_id long, text string")
    assert {r["doc_id"]: r["exact"] for r in sentencepiece_lattice.summary(odd).collect()} == {None: False, 1: True}
    whole = sentencepiece_lattice.summary(docs)
    assert Counter(r["doc_id"] for r in whole.collect()) == Counter(i for i, *_ in corpus()) and whole.filter("exact").count() == len(corpus())
    assert sentencepiece_lattice.summary(empty).count() == 0


def test_units_are_the_form():
    for t in [t for _, t, *_ in corpus() if t] + [t for _, t in STRANGE]:
        for cut in ("letters", "words", "texts"):
            into, apart = sentencepiece_lattice.splitter(cut)
            assert "".join(u for w in into(t) for u in apart(w)) == "▁" + t.replace(" ", "▁")
    assert sentencepiece_lattice.Pieces.load().cut == "letters"


def test_chat(spark):
    calls = [
        ("a", "reply", '{"turn": 1, "prompt": "x"}', [], 1, "k"),
        ("b", "reply", '{"prompt": 5, "turn": -1}', ["a", "nowhere"], 2, "k"),
        ("c", "reply", "no json", ["a", "b"], 3, "k"),
        ("d", "search", "{}", ["e"], 4, "k"),
        ("e", "reply", '{"turn": 1}', ["d"], 5, "k"),
        (None, "reply", None, None, 6, "k"),
    ]
    results = [("a", "later", 9), ("a", 'q"\n\u0001\\', 2), ("zz", "x", 1), (None, "y", 1)]
    out = chat_format.link(spark.createDataFrame(calls, "id string, name string, arguments string, depends_on array<string>, turn long, level0 string"), spark.createDataFrame(results, "id string, content string, turn long"))
    got = {r["id"]: r for r in out.collect()}
    assert {k: r["level"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, None: 0}
    assert {k: r["missing"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 0, "d": 0, "e": 0, None: 0}
    assert got["a"]["valid"] and got["a"]["n_results"] == 2
    assert got["a"]["message"] == '{"arguments":{"prompt":"x","turn":1},"depends_on":[],"id":"a","name":"reply","result":{"content":"q\\"\\n\\u0001\\\\","turn":2},"type":"tool_call"}'
    assert got["b"]["problems"] == ["prompt: not string", "turn: beyond minimum"]
    assert got["c"]["problems"] == ["arguments: not an object"] and '"arguments":"no json"' in got["c"]["message"]
    assert got["d"]["problems"] == ["unknown tool"] and got["e"]["problems"] == ["prompt: missing"]
    chain = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 300)], "id string, dep string")
    assert {int(r["id"]): r["level"] for r in chat_format.levels(chain).collect()} == {i: i for i in range(1, 300)}
    ring = [(str(i), str((i + 1) % 50)) for i in range(50)] + [("x", "3"), ("self", "self"), ("y", "self"), ("a1", "a0"), ("a2", "a1")]
    got = {r["id"]: r["level"] for r in chat_format.levels(spark.createDataFrame(ring, "id string, dep string")).collect()}
    assert got == {i: {"a1": 1, "a2": 2}.get(i) for i, _ in ring}
    several = [("a", "b"), ("a", "c"), ("b", "c"), ("r", "r"), ("q", "r"), ("q", "a")]
    got = {r["id"]: r["level"] for r in chat_format.levels(spark.createDataFrame(several, "id string, dep string")).collect()}
    assert got == {"a": 2, "b": 1, "r": None, "q": None}
    clash = "id string, name string, arguments string, depends_on array<string>, turn long, Level string, deps string, result string, n_results int, content string, dep long"
    rows = [("a", "reply", "{}", None, 1, "k", "k", "k", 7, "k", 1), ("a", "reply", "{}", [], 1, "k", "k", "k", 7, "k", 1), ("b", "reply", "{}", ["a"], 2, "k", "k", "k", 7, "k", 2)]
    out = chat_format.link(spark.createDataFrame(rows, clash), spark.createDataFrame([("b", "x", 3)], "id string, content string, turn long"))
    assert sorted((r["id"], r["level"], r["deps"], r["result"], r["n_results"], r["content"], r["dep"]) for r in out.collect()) == [("a", 0, [], "k", 0, "k", 1)] * 2 + [("b", 1, ["a"], "k", 1, "k", 2)]
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.link(*chat_format.from_turns(nothing)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r[:5] for r in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] == 4)) for r in rows if r[0] % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS, name
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            n = docs.count()
            assert n and (before is None or name == "mixing" or n <= before)
            before = n
    assert docs.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "mixing", "sentencepiece"]


def test_pipeline_edges(spark, tmp_path):
    """Null and repeated ids, null and empty texts, clashing columns, no labels; and no rows at all."""
    import corpus_pipeline

    rows = [(None, "a b c", "en", None, None, "x"), (1, None, None, "a", 0, "x"), (1, "", "en", "a", 0, "x"), (1, "", "en", "a", 0, "x"), (2, "w " * 300, "de", "b", 600, "x"), (None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert name == "sentencepiece" or docs.columns == corpus_pipeline.COLUMNS
            docs.write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{k}-{name}")
        found = docs.collect()
        assert all(r["exact"] for r in found) and (len(found) > 0) == (k == 0)
