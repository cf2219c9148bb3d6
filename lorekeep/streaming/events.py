"""Streaming extensions over the events table; the batch engine has no streams of its own.

Windows with watermarks for arrivals, receipts that are taken once, and hit
counters by scope. The batch forms give the same rows and serve as their check.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream, their time in UTC."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def arrivals(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Events and their values by type and window; tumbling, or sliding with ``slide``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def first_receipts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each receipt once within the watermark; in batch, once at all."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def hit_counters(events: DataFrame) -> DataFrame:
    """A running count of hits for each user, kept as state."""

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits = (state.get[0] if state.exists else 0) + sum(len(p) for p in parts)
        state.update((hits,))
        yield pd.DataFrame({"user_id": [key[0]], "hits": [hits]})

    return events.groupBy("user_id").applyInPandasWithState(count, "user_id long, hits long", "hits long", "update", GroupStateTimeout.NoTimeout)
