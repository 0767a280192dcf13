"""Event-time sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(stream: DataFrame, keys: list[str], time: str, gap: str, delay: str) -> DataFrame:
    """Sessions per key: rows at most ``gap`` apart. Rows later than ``delay`` behind are dropped.

    Emitted in append mode once the watermark has passed the end of a session, so the state
    holds open sessions only.
    """
    timed = stream.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", delay)
    return (
        timed.groupBy(*keys, F.session_window("_ts", gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min("_ts").alias("first"), F.max("_ts").alias("last"))
        .drop("_w")
    )
