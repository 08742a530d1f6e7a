"""Quality rules: count rules first, then the divergence of a document from its language.

A document is described by two histograms: its characters by class, and its words by membership in a fixed
list of common words. The reference of a language is the sum of the histograms of all its documents that pass
the count rules. A document is dropped when the Jensen-Shannon distance (base 2, so between 0 and 1) of
either histogram to the reference passes a limit, unless it is too short to be judged by that histogram. The limit
of the words comes from the reference: it is the distance ``d`` of a document without any common word, times
``0.75 + 0.25 * sqrt(word_least / n_words)``, for the distances of few words spread more. A reference with less than
``COMMON_LEAST`` of common words judges no words.

Edge cases: a null or empty text has no words and so fails the count rules; a null or unlisted language is
held against the pooled reference of all documents; a language without any passing document too; a row's
verdict depends on that row and the references only, so repeated rows agree; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mudlark.llm.common import GAP, cut

#: Common words of the four languages, in no language's favour; a word counts by its lower case.
COMMON = (
    "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "de la que el en y los se del las un por con no una su para al lo como más pero sus le "
    "les des du et à il pour dans ce qui ne pas sur au avec plus par elle ou une"
).split()
COMMON = list(dict.fromkeys(COMMON))
#: Languages with a reference of their own; the number of references is bounded by this list.
LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "sv", "pl", "ru", "zh", "ja")
COMMON_LEAST = 0.05
#: Character classes, as patterns of what is not in the class.
CLASSES = {
    "lower": r"[^\p{Ll}]+",
    "upper": r"[^\p{Lu}]+",
    "digit": r"[^\p{Nd}]+",
    "space": r"[^\x20\x09-\x0D]+",
    "stop": r"[^.,;:!?'\"()-]+",
    "symbol": r"[^#*$%&|<>]+",
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(ws: Column) -> Column:
    """A 64-bit hash of each window of three words; no windows below four words, for one can't repeat."""
    spans = F.transform(F.sequence(F.lit(1), F.size(ws) - 2), lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2)))
    return F.when(F.size(ws) >= 4, spans).otherwise(F.array().cast("array<bigint>"))


def covered(spans: Column) -> Column:
    """How many words lie in windows that occur twice or more.

    Sorted hashes with equal neighbours are the repeated windows; their places, in order, each add up to
    three words that the last one didn't cover.
    """
    placed = F.sort_array(F.transform(spans, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(placed, lambda p: F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"])


def base(docs: DataFrame) -> DataFrame:
    """Adds the count rules' columns to documents: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_words", F.filter(F.split(text, GAP), lambda w: w != ""))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.regexp_replace(text, GAP, "")).cast("long"))
    out = out.withColumn("n_symbols", F.length(F.regexp_replace(text, CLASSES["symbol"], "")).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = out.withColumn("_spans", windows(F.col("_words")))
    # Only a text with some repeated window pays for sorting.
    count = F.when(F.size(F.array_distinct("_spans")) < F.size("_spans"), covered(F.col("_spans"))).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("n_repeat_words", count)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_lines", "_spans")


def histograms(docs: DataFrame) -> DataFrame:
    """Adds ``chars`` and ``commons``, arrays of counts; the last entry of each counts all others. Needs ``_words``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = [F.length(F.regexp_replace(text, pattern, "")) for pattern in CLASSES.values()]
    out = docs.withColumn("_counts", F.array(*counts)).withColumn("chars", F.concat("_counts", F.array(F.length(text) - F.aggregate("_counts", F.lit(0), lambda a, x: a + x))))
    # Each common word becomes one character, so a histogram is a few passes over a short string.
    codes = F.array(*[F.lit(chr(0x100 + i)) for i in range(len(COMMON))])
    known = F.array(*[F.lit(w) for w in COMMON])
    # A set decides whether a word is common; only those that are get looked for in the list.
    common = F.filter(F.transform("_words", F.lower), lambda w: w.isin(*COMMON))
    coded = F.array_join(F.transform(common, lambda w: F.element_at(codes, F.array_position(known, w).cast("int"))), "")
    out = out.withColumn("_coded", coded)
    each = [(F.length("_coded") - F.length(F.replace("_coded", F.lit(chr(0x100 + i)), F.lit("")))).cast("int") for i in range(len(COMMON))]
    out = out.withColumn("commons", F.concat(F.array(*each), F.array((F.col("n_words") - F.length("_coded")).cast("int"))))
    return out.drop("_counts", "_coded", "_words")


def references(features: DataFrame) -> dict[str | None, dict[str, list[float]]]:
    """The distributions of each listed language and, under None, of all: at most one row a listed language comes to the driver."""
    lang = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang"))
    sums = [F.sum(F.get(name, F.lit(i))).cast("double").alias(f"{name}_{i}") for name, n in (("chars", len(CLASSES) + 1), ("commons", len(COMMON) + 1)) for i in range(n)]
    rows = features.filter(~F.col("base_failed")).groupBy(lang.alias("lang")).agg(*sums).collect()
    found: dict[str | None, dict[str, list[float]]] = {}
    sized = (("chars", len(CLASSES) + 1), ("commons", len(COMMON) + 1))
    for name, n in sized:
        pooled = [0.0] * n
        for r in rows:
            own = [r[f"{name}_{i}"] or 0.0 for i in range(n)]
            pooled = [a + b for a, b in zip(pooled, own, strict=True)]
            if r["lang"] is not None and sum(own):
                found.setdefault(r["lang"], {})[name] = [x / sum(own) for x in own]
        found.setdefault(None, {})[name] = [x / sum(pooled) for x in pooled] if sum(pooled) else [1.0 / n] * n
    return found


def word_limits(known: dict) -> dict[str | None, float | None]:
    """For each reference the word distance of a document without common words; None where it has too few itself."""
    found: dict[str | None, float | None] = {}
    for lang, dists in known.items():
        q = dists.get("commons")
        if q is not None:
            p = [0.0] * (len(q) - 1) + [1.0]
            part = sum(a * math.log2(2 * a / (a + b)) if a else 0.0 for a, b in zip(p, q, strict=True)) + sum(b * math.log2(2 * b / (a + b)) if b else 0.0 for a, b in zip(p, q, strict=True))
            found[lang] = math.sqrt(part / 2) if 1 - q[-1] >= COMMON_LEAST else None
    return found


def judge(docs: DataFrame, char_limit: float = 0.25, char_least: int = 200, word_least: int = 75) -> DataFrame:
    """doc_id and all columns of the rules: counts, ``char_distance``, ``word_distance``, base_failed and kept.

    ``char_least`` characters in words and ``word_least`` words are the guards: below them a histogram is
    too thin to be held against a language, and the document stays.
    """
    features = cut(histograms(base(docs.select("doc_id", "text", "lang"))).drop("text"), "quality")
    known = references(features)
    which = lambda name: _by_language(known, name)
    out = features.withColumn("char_distance", which("chars")).withColumn("word_distance", which("commons"))
    limits = word_limits(known)
    top = F.lit(limits[None]).cast("double")
    for lang, at in limits.items():
        if lang is not None:
            top = F.when(F.col("lang") == lang, F.lit(at).cast("double")).otherwise(top)
    far = F.col("word_distance") > top * (0.75 + 0.25 * F.sqrt(F.lit(float(word_least)) / F.greatest("n_words", F.lit(1))))
    odd = ((F.col("word_chars") >= char_least) & (F.col("char_distance") > char_limit)) | ((F.col("n_words") >= word_least) & F.coalesce(far, F.lit(False)))
    kept = ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))
    return out.withColumn("kept", kept).drop("chars", "commons")


def _by_language(known: dict, name: str) -> Column:
    """The distance to the row's own reference: the literal references are few and fixed, so no join is needed."""
    pooled = F.array(*[F.lit(x) for x in known[None][name]])
    reference = pooled
    for lang, dists in known.items():
        if lang is not None and name in dists:
            reference = F.when(F.col("lang") == lang, F.array(*[F.lit(x) for x in dists[name]])).otherwise(reference)
    return _distance(F.col(name), reference)


def _distance(counts: Column, reference: Column) -> Column:
    """The Jensen-Shannon distance, base 2, of an array of counts to a distribution; null if nothing is counted."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def part(c: Column, q: Column, total: Column) -> Column:
        p = c / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))

    summed = let(total, lambda t: F.aggregate(F.zip_with(counts, reference, lambda c, q: part(c, q, t)), F.lit(0.0), lambda a, x: a + x))
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), summed / 2)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shown = [F.round(c, 4).alias(c) for c in ("char_distance", "word_distance")]
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *shown)
