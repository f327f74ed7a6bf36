"""Structured Streaming over the event log: late and repeated events, windows, running budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events*.parquet", files_per_trigger: int = 16) -> DataFrame:
    """A stream of the event files that appear in a folder, with ``ts`` as a timestamp."""
    stream = spark.readStream.schema(EVENT).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def once_each(events: DataFrame, key: str = "event_id", delay: str = "3 days") -> DataFrame:
    """Each key once within the delay; state older than the watermark is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """(start, event_type, n, total): counts per tumbling or sliding window; rows later than the watermark are left out."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): sessions of a user, ended by a gap without events."""
    grouped = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_failures(events: DataFrame, limit: int = 2, delay: str | None = "1 day") -> DataFrame:
    """(user_id, event_id, failures): errors since the last purchase, for events that reach ``limit``; state per user is one number.

    Events of a batch are taken in order of time and id; a user's state expires when the watermark passes a day after it.
    ``delay`` is None for a stream that has its watermark already.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (failures,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for kind, event in zip(rows["event_type"], rows["event_id"]):
            failures = 0 if kind == "purchase" else failures + (kind == "error")
            if kind == "error" and failures >= limit:
                out.append((key[0], event, failures))
        state.update((int(failures),))
        latest = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "failures"])

    marked = events.withWatermark("ts", delay) if delay else events
    kept = marked.where("user_id is not null").select("user_id", "event_id", "ts", "event_type")
    return kept.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, failures int", "failures int", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns its output as a table of the session."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
