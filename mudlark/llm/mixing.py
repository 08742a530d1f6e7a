"""Mixing sources to target weights by entropy balancing.

Every source gets a target in words. Each document starts at a rate of one copy; the rates that meet the
targets and stay closest to that start, in the entropy of a rate between 0 and ``cap`` copies, are
``cap / (1 + (cap - 1) * exp(-lambda * size / mean))``: an exponential tilt of the odds. One ``lambda`` a source solves
the convex dual, found by Newton steps that are Spark aggregations over the histogram (source, size, rows),
a table which grows with the number of different sizes and not with the rows. The rates are then rounded
into whole copies so that the error of a source stays below one short document.

Edge cases: a null text has size 0 and is never copied; a null source is a source of its own, ordered last;
repeated rows are documents of their own; an empty table gives an empty result. Columns other than
``doc_id``, ``text`` and ``source`` are passed through by :func:`apply_mix` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mudlark.llm.common import cut, n_words

#: Parts that a class of documents of one source and size is dealt into for ranking.
PARTS = 256


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with ``target``: the level at which weighted shares, each stopped at its cap, meet the total.

    Shares are reshared until none is above its cap; that is water-filling, so with the sources in order of
    cap by weight the level follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("ratio", F.col("ceiling") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)
    target = F.when(F.col("final").isNull(), F.col("ceiling")).otherwise(F.least("ceiling", F.col("weight") * F.col("final.level")))
    return ranked.withColumn("final", final).select("source", "source_size", target.alias("target"))


def _rate(tilt, size, mean, cap: float):
    return F.lit(cap) / (1 + F.lit(cap - 1.0) * F.exp(-tilt * size / mean))


def balance(classes: DataFrame, goals: DataFrame, cap: float = 2.0, tolerance: float = 1e-6, most: int = 60, together: int = 4) -> DataFrame:
    """Newton's method on the dual: (source, size, rows) and (source, source_size, target, mean) -> goals with ``tilt``.

    From a tilt of 0 the steps go one way and can't pass the root where ``cap`` is 2, for the total is concave
    in a positive tilt and convex in a negative one. A source whose target is its ceiling needs no step.
    ``together`` steps make one job. The state has one row a source and is broadcast up to 10,000 of them.
    """
    state = cut(goals.withColumn("tilt", F.lit(0.0)).withColumn("off", F.lit(1.0)), "mix-state")
    small = state.count() <= 10_000
    hint = F.broadcast if small else lambda x: x
    for _ in range(-(-most // together)):
        for _ in range(together):
            rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
            slope = rate * (1 - rate / cap) * F.col("size") / F.col("mean")
            sums = (
                classes.join(hint(state.select("key", "tilt", "mean")), "key")
                .groupBy("key")
                .agg(F.sum(F.col("rows") * F.col("size") * rate).alias("total"), F.sum(F.col("rows") * F.col("size") * slope).alias("slope"))
            )
            step = F.when(F.col("full") | F.col("slope").isNull() | (F.col("slope") <= 0), F.lit(0.0)).otherwise((F.col("target") - F.col("total")) / F.col("slope"))
            off = F.when(F.col("full") | F.col("total").isNull(), F.lit(0.0)).otherwise(F.abs(F.col("target") - F.col("total")) / F.greatest(F.col("target"), F.lit(1.0)))
            state = state.drop("off").join(hint(sums), "key", "left").withColumn("off", off).withColumn("tilt", F.col("tilt") + F.greatest(F.lit(-50.0), F.least(F.lit(50.0), step))).drop("total", "slope")
        state = cut(state, "mix-state")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return state


def copies(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc_id, source, size, tie) -> doc_id, source, size, tie, source_size, target, rate, copies: the whole mix."""
    spark = sized.sparkSession
    sized = sized.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).withColumn("part", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(PARTS)))
    parts = cut(sized.groupBy("key", "source", "size", "part").agg(F.count("*").alias("part_rows")), "mix-classes")
    classes = parts.groupBy("key", "source", "size").agg(F.sum("part_rows").alias("rows"))
    goals = targets(classes.groupBy("source").agg(F.sum(F.col("rows") * F.col("size")).alias("source_size")), weights, share, cap)
    spread = classes.groupBy("key", "source").agg(F.sum("rows").alias("source_rows"))
    goals = goals.join(spread, goals["source"].eqNullSafe(spread["source"])).drop(spread["source"])
    goals = goals.withColumn("mean", F.greatest(F.col("source_size") / F.col("source_rows"), F.lit(1e-9))).withColumn("full", F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-9)))
    solved = balance(classes.filter("size > 0"), goals, cap)

    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean"), cap))
    rated = classes.join(solved.select("key", "source_size", "target", "mean", "full", "tilt"), "key").withColumn("rate", rate)
    # From the longest documents down, running sums of the wished copies are rounded; what is then amiss
    # is made good with the shortest documents.
    down = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    wished = F.when(F.col("size") > 0, F.col("rows") * F.col("rate")).otherwise(0.0)
    rated = rated.withColumn("upto", F.floor(F.sum(wished).over(down) + 0.5)).withColumn("wished", wished)
    last = Window.partitionBy("key").orderBy(F.col("size").desc())
    ceiling = F.floor(F.col("rows") * F.lit(float(cap)))
    got = F.least(ceiling, F.greatest(F.lit(0), F.col("upto") - F.coalesce(F.lag("upto").over(last), F.lit(0)))).cast("long")
    rated = rated.withColumn("got", F.when(F.col("size") > 0, got).otherwise(F.lit(0)).cast("long"))
    whole = Window.partitionBy("key")
    rated = rated.withColumn("amiss", F.col("target") - F.sum(F.col("got") * F.col("size")).over(whole))
    room = F.when(F.col("size") == 0, F.lit(0)).when(F.col("amiss") > 0, ceiling - F.col("got")).otherwise(F.col("got"))
    rated = rated.withColumn("room", room.cast("long"))
    up = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.abs("amiss") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(up), F.lit(0))
    mend = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("room"), F.floor(left / F.greatest("size", F.lit(1)) + 0.5)))).otherwise(0)
    rated = rated.withColumn("got", (F.col("got") + F.when(F.col("amiss") > 0, mend).otherwise(-mend)).cast("long"))

    # Within a class of equal sizes the first rows by hash get one copy more; a class is ranked in parts.
    earlier = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("skip", F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)))
    plan = parts.drop("source").join(rated.select("key", "size", "rows", "got", "rate", "source_size", "target"), ["key", "size"])
    within = Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("tie", "doc_id"), "doc_id", "tie")
    placed = sized.withColumn("place", F.row_number().over(within)).join(plan, ["key", "size", "part"])
    each = F.floor(F.col("got") / F.col("rows"))
    more = F.when(F.col("place") + F.col("skip") <= F.col("got") - each * F.col("rows"), 1).otherwise(0)
    return placed.select("doc_id", "source", "size", "tie", "source_size", "target", "rate", (each + more).cast("long").alias("copies"))


def sizes(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, source, size in words, and a hash of the text that orders equal ids."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and ``taken``, the words that the mix takes of each document."""
    sized = cut(sizes(docs), "mix-sizes")
    return copies(sized, weights, share, cap).drop("tie").withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them, with all columns of ``docs``."""
    names = docs.columns
    held = docs.withColumn("_size", n_words(F.col("text"))).withColumn("_tie", F.xxhash64("text"))
    counted = copies(cut(held.select("doc_id", "source", F.col("_size").alias("size"), F.col("_tie").alias("tie")), "mix-sizes"), weights, share, cap)
    counted = counted.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("tie").alias("_tie2")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    same = held["doc_id"].eqNullSafe(counted["_id"]) & held["source"].eqNullSafe(counted["_source"]) & (held["_tie"] == counted["_tie2"])
    # Rows alike in id, source and text share their copies: each gets the whole part, the first ones by position the rest.
    joined = held.join(counted, same)
    alike = Window.partitionBy("doc_id", "source", "_tie").orderBy("_tie")
    joined = joined.withColumn("_place", F.when(F.col("_rows") == 1, F.lit(1)).otherwise(F.lit(0)))
    single = joined.filter("_rows = 1").withColumn("_take", F.col("_copies"))
    many = joined.filter("_rows > 1").withColumn("_place", F.row_number().over(alike))
    many = many.withColumn("_take", F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_place") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0))
    taken = single.unionByName(many).filter("_take > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_take").cast("int")))).select(*names)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")
