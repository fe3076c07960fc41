"""Structured Streaming over the events table: windowed counts with late data, cooldowns per key, resumable scans.

The batch systems this engine replaces poll durable state; these are additions that do the same as streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.stages import shared_folder


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 16, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)


def window_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): counts and sums per window and type; rows later than `late` behind the newest are dropped."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once, as long as its repeats come within `late`."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def cooled_down(events: DataFrame, hours: int = 1) -> DataFrame:
    """(user_id, ts): events of a user let through only if the last let through is `hours` or more before; state is one time per user."""
    gap = pd.Timedelta(hours=hours)

    def let_through(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        times = pd.concat([b["ts"] for b in batches]).sort_values()
        kept = []
        for t in times:
            if last is None or t - last >= gap:
                kept.append(t)
                last = t
        if last is not None:
            state.update((int(last.value // 1000),))
        yield pd.DataFrame({"user_id": key[0], "ts": pd.Series(kept, dtype="datetime64[ns]")})

    return events.groupBy("user_id").applyInPandasWithState(let_through, "user_id long, ts timestamp", "last long", "append", "NoTimeout")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Process what there is into the shared folder and stop; running it again goes on where it ended."""
    base = f"{shared_folder(stream.sparkSession)}/streams/{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    return writer.format("parquet").option("path", f"{base}/rows").start() if mode == "append" else writer.format("memory").queryName(name).start()
