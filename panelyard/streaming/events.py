"""Event streams: windows with late data, sessions, and an anchored cooldown kept in state.

Each function takes a streaming or a static frame of ``events`` (ts, user_id,
event_type, value); on a static frame it gives what the stream gives once all data
have come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def late(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("ts", delay)


def tumbling(events: DataFrame, size: str = "1 day", delay: str = "1 day") -> DataFrame:
    """start, event_type, n, total: counts and sums by window."""
    g = late(events, delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sliding(events: DataFrame, size: str = "7 days", step: str = "1 day", delay: str = "1 day") -> DataFrame:
    g = late(events, delay).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "users")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """user_id, start, end, n: runs of events with no gap of ``gap`` or more."""
    g = late(events, delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    return late(events, delay).dropDuplicatesWithinWatermark(["event_id"])


def cooldown(events: DataFrame, gap_seconds: int, delay: str = "1 day") -> DataFrame:
    """user_id, ts: events kept one after another, each ``gap_seconds`` or more after the last kept; the anchor lives in state.

    Events are taken in the order of time within a trigger; one that comes after a
    later kept event is not kept.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for f in frames for t in f["ts"])
        kept = []
        for t in times:
            if last is None or t.timestamp() - last >= gap_seconds:
                kept.append(t)
                last = t.timestamp()
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(kept), "ts": kept})

    grouped = late(events, delay).select("user_id", "ts").groupBy("user_id")
    return grouped.applyInPandasWithState(keep, "user_id long, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """All available data into an in-memory table, then stop (for tests and backfills)."""
    q = df.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
