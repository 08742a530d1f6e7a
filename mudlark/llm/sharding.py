"""Shards by balanced label propagation: equal texts move together while row counts stay at most one apart.

Documents with equal texts are linked; a document starts in the shard that its id's hash names. In a round
every group of equal texts looks at the shards of its members and wants the shard that holds most of them,
among those with room; members elsewhere ask to move there. A shard admits what its quota leaves room for:
of many requests the share that fits, chosen by hash, and of a large block of equal texts that share of its rows.
Members of one group in one shard are alike, so the rounds work on counts (group, shard, rows) and a
group of any size is at most one row a shard. At the end the counts become places: members are ranked in
their group, and unlinked documents fill the shards up to the exact quotas.

Law ``rows``: shard sizes differ by one row at most. Edge cases: a null text has no bytes, checksum 0 and no
links; empty texts are linked like others; a null doc_id is hashed like any value; rows alike in all
columns are ranked in some order, which can't be told from the result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mudlark.llm.common import cut

#: Parts that a group or shard is dealt into for ranking, so no task ranks a whole one.
PARTS = 128
#: Rows from which a block of equal texts is admitted in part.
BLOCK = 64


def numbers(values: list[int | float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def at(values: list[int | float], index: Column) -> Column:
    return F.get(numbers(values), index)


def by_shard(df: DataFrame, shard: str, value: Column, shards: int) -> list[int]:
    """A sum for each shard, at the driver: ``shards`` numbers."""
    found = {r[0]: int(r[1] or 0) for r in df.groupBy(shard).agg(F.sum(value)).collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(cells: DataFrame, quotas: list[int], rounds: int = 16) -> DataFrame:
    """Rounds over (key, shard, n): where the members of each group are."""
    shards = len(quotas)
    for turn in range(rounds):
        loads = by_shard(cells, "shard", F.col("n"), shards)
        room = [max(0, q - x) for q, x in zip(quotas, loads, strict=True)]
        rank = F.struct(F.when(at(room, F.col("shard")) > 0, F.col("n")).otherwise(F.lit(-1)).alias("n"), F.xxhash64("key", "shard").alias("tie"), F.col("shard").alias("shard"))
        best = cells.groupBy("key").agg(F.max(rank).alias("best")).filter("best.n >= 0").select("key", "best")
        wish = cells.join(best, "key", "left")
        behind = F.col("best").isNotNull() & (F.col("shard") != F.col("best.shard")) & ((F.col("n") < F.col("best.n")) | ((F.col("n") == F.col("best.n")) & (F.xxhash64("key", "shard") < F.col("best.tie"))))
        wish = cut(wish.withColumn("want", F.when(behind, F.col("best.shard"))).drop("best"), "shard-wish")
        asked = by_shard(wish.filter("want is not null"), "want", F.col("n"), shards)
        if not sum(asked):
            break
        share = at([min(1.0, r / a) if a else 0.0 for r, a in zip(room, asked, strict=True)], F.col("want"))
        lot = F.pmod(F.xxhash64("key", "shard", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        go = F.when(F.col("want").isNull(), F.lit(0)).when(F.col("n") >= BLOCK, F.floor(F.col("n") * share)).when(lot < share, F.col("n")).otherwise(F.lit(0)).cast("long")
        moved = wish.withColumn("go", go)
        both = F.explode(F.array(F.struct(F.col("shard").alias("s"), (F.col("n") - F.col("go")).alias("m")), F.struct(F.coalesce("want", "shard").alias("s"), F.col("go").alias("m"))))
        cells = cut(moved.select("key", both.alias("x")).filter("x.m > 0").groupBy("key", F.col("x.s").alias("shard")).agg(F.sum("x.m").alias("n")), "shard-cells")
    return cells


def place(rows: DataFrame, shards: int) -> DataFrame:
    """(doc_id, key) and anything else -> the same with ``shard`` and ``slot``; a null key has no links."""
    rows = cut(
        rows.withColumn("_home", F.pmod(F.xxhash64("doc_id", "key"), F.lit(shards)).cast("int")).withColumn("_part", F.pmod(F.xxhash64("key", "doc_id", F.lit(1)), F.lit(PARTS)).cast("int")),
        "shard-rows",
    )
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    groups = rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("all")).filter("all > 1").select("key")
    linked = rows.join(groups, "key", "left_semi")
    cells = cut(linked.groupBy("key", F.col("_home").alias("shard")).agg(F.count("*").alias("n")), "shard-cells")
    cells = propagate(cells, quotas)

    # A group's members, ranked in parts, go to its shards by running bounds.
    spans = cells.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("spans"))
    parts = rows.filter("key is not null").groupBy("key", "_part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("skip", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = parts.join(spans, "key").select("key", "_part", "skip", "spans")
    ranked = rows.join(plan, ["key", "_part"], "left")
    within = Window.partitionBy("key", "_part").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = ranked.filter("spans is not null").withColumn("_rank", F.col("skip") + F.row_number().over(within))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("shard"))
    pick = F.aggregate("spans", start, lambda a, x: F.when(a["sum"] >= F.col("_rank"), a).otherwise(F.struct((a["sum"] + x["n"]).alias("sum"), x["shard"].alias("shard"))), lambda a: a["shard"])
    known = known.withColumn("_shard", pick).withColumn("_free", F.lit(0)).drop("_rank")
    alone = ranked.filter("spans is null").withColumn("_shard", F.col("_home")).withColumn("_free", F.lit(1))
    named = cut(known.unionByName(alone).drop("skip", "spans", "_home"), "shard-named")

    # Linked rows first, each shard keeps as many as its quota; what is over fills the others.
    counts = {(r[0], r[1], r[2]): r[3] for r in named.groupBy("_shard", "_free", "_part").count().collect()}
    size = [sum(counts.get((s, f, p), 0) for f in (0, 1) for p in range(PARTS)) for s in range(shards)]
    skips: dict[tuple[int, int], list[int]] = {}
    for s in range(shards):
        run = 0
        for f in (0, 1):
            skips[s, f] = []
            for p in range(PARTS):
                skips[s, f].append(run)
                run += counts.get((s, f, p), 0)
    flat = [x for s in range(shards) for f in (0, 1) for x in skips[s, f]]
    over = [max(0, n - q) for n, q in zip(size, quotas, strict=True)]
    space = [max(0, q - n) for n, q in zip(size, quotas, strict=True)]
    before = [sum(over[:s]) for s in range(shards)]
    upto = [sum(space[: s + 1]) for s in range(shards)]
    line = Window.partitionBy("_shard", "_free", "_part").orderBy(F.xxhash64("key", "doc_id"), "doc_id")
    out = named.withColumn("_place", at(flat, (F.col("_shard") * 2 + F.col("_free")) * PARTS + F.col("_part")) + F.row_number().over(line) - 1)
    out = out.withColumn("_over", F.when(F.col("_place") >= at(quotas, F.col("_shard")), at(before, F.col("_shard")) + F.col("_place") - at(quotas, F.col("_shard"))))
    target = F.size(F.filter(numbers(upto), lambda x: x <= F.col("_over")))
    out = out.withColumn("shard", F.when(F.col("_over").isNull(), F.col("_shard")).otherwise(target).cast("int"))
    first = [n - (upto[s] - space[s]) for s, n in enumerate(size)]
    out = out.withColumn("slot", F.when(F.col("_over").isNull(), F.col("_place")).otherwise(F.col("_over") + at(first, F.col("shard"))).cast("long"))
    return out.drop("_shard", "_free", "_part", "_place", "_over")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, key (digest of the text), shard and slot of every document."""
    text = F.encode("text", "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.sha2(text, 256).alias("key"),
    )
    return place(rows, shards)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "key")
