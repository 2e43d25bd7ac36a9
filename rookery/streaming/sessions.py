"""Sessions over a stream: merging interval state with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, lateness: str) -> DataFrame:
    """(key, start, end, n_events) of the sessions of a streaming DataFrame.

    State is kept per open session. An event up to ``lateness`` behind the newest event time still widens or
    joins sessions; in append mode a session comes out once the watermark has passed its end. Rows with a
    null key or time are dropped. ``start`` and ``end`` are the times of the first and last event.
    """
    live = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("t"))
    return (
        live.withWatermark("t", lateness)
        .groupBy("k", F.session_window("t", f"{gap_seconds} seconds").alias("w"))
        .agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n_events"))
        .select(F.col("k").alias(key), "start", "end", "n_events")
    )


def stream_counts(events: DataFrame, keys: list[str], ts: str, window: str, lateness: str) -> DataFrame:
    """(keys, start, n) of tumbling windows over a streaming DataFrame, late rows up to ``lateness`` included."""
    return (
        events.withColumn("t", F.col(ts).cast("timestamp"))
        .withWatermark("t", lateness)
        .groupBy(*keys, F.window("t", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("start"), "n")
    )
