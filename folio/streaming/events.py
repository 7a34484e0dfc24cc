"""Structured Streaming over the event stream: windows with late data, sessions, and first-delivery deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream, with an explicit schema."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, events, total): counts per window and type; works on a stream and on a table alike."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        source.groupBy(F.window("ts", size), "event_type")
        .agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "events", "total")
    )


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """(user_id, start, finish, events): sessions of each user, closed by a gap."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        source.groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("events"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "events")
    )


def first_deliveries(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events without repeated deliveries of an id within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, events, total): running totals of each user after every batch, kept in arbitrary state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, events long, total double", "events long, total double", "update", GroupStateTimeout.NoTimeout
    )
