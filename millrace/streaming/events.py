"""Structured Streaming forms of the metrics: they read parquet files as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the event files in ``folder``."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Count and sum of each client and hour; state of hours behind the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "60 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each client, closed after ``gap`` without an event."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def unseen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_means(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(user_id, n, mean) after each batch, by state of two numbers for a client, which ends two idle hours later."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame["value"].sum())
            last = max(last, int(frame["ts"].max().timestamp() * 1000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 2 * 60 * 60 * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [total / n if n else 0.0]})

    ship(events.sparkSession)
    kept = events.withWatermark("ts", late).select("user_id", "ts", "value")
    return kept.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, mean double", "n long, total double, last long", "update", "EventTimeTimeout")


def start(stream: DataFrame, sink: str, name: str, checkpoint: str, mode: str = "append"):
    """Starts ``stream`` into a parquet folder or a memory table, over all that is there, then stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if sink == "memory":
        return writer.format("memory").queryName(name).start()
    return writer.format("parquet").option("path", sink).start()
