"""A corpus pipeline of five stages; each is written as Parquet and read again by the next.

Toxic documents go, one document of each class of near-duplicates stays, repeated byte strings and passages
of over 50 words are cut out of the texts, sources are mixed to target weights (a document taken twice is two rows), and the texts are encoded.
All stages but the last return the columns of ``documents``; the last returns doc_id, n_pieces, ids_sha256, exact and ids.

Edge cases: columns beyond those of ``documents`` are dropped at the first stage; null ids and rows that repeat are handled
as each operator says (rows equal in id and text are one document to the near-duplicates); a null text is an empty one,
is never toxic, and the mix takes it no more than any text without words: not at all; without labels of both kinds no
document is toxic; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudlark.llm import bagminhash, mixing, sentencepiece_lattice, suffix_dedup, toxicity
from mudlark.llm.common import cut, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return bagminhash.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    # Strings of 400 bytes, as op3 cuts them, and then passages of over 50 words, which can be shorter.
    out = suffix_dedup.dedup_words(suffix_dedup.dedup(docs.select(*COLUMNS)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return mixing.apply_mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return sentencepiece_lattice.summary(docs.select("doc_id", "text"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A trained classifier and signatures can't be put in SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
