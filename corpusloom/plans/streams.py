"""Queries that run as streams over what is there, held against their batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import events as S
from .catalog import query


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"windows_{uuid.uuid4().hex}"
    stream = S.read_events(spark, sf_dir, table(spark, sf_dir, "events").schema, glob="events.parquet")
    S.run_available(S.window_counts(stream), name, "complete").awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
