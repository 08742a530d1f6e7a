"""Windows over event streams: beyond what files need, for tables that grow.

Counts per window and type with a watermark, and sessions by gap; both run on a batch or a stream alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and value sums per window and type; events later than ``late`` are left out of a stream."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return held.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's runs of events with no longer gap than ``gap``."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return held.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
