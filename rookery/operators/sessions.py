"""Sessions of activity by merging interval state.

Every event opens the interval [t, t + gap); intervals of one key that overlap or touch merge, and what is
left are the sessions. Merging is associative, so it runs in two rounds: events merge inside (key, chunk of
time, part), and the resulting pieces merge per key. Parts divide the records of chunks that are too large
for a task, by a hash of the record, so neither a key with a third of all rows nor a burst within a single
second meets in one task; all other chunks are one part. Pieces of one part lie more than a gap apart, so a
key has no more of them than parts times the gaps of its calendar, however many events it has.
The streaming form, with a watermark, is :mod:`rookery.streaming.sessions`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions.timex import micros
from rookery.operators.skew import ROWS_PER_TASK, hot_groups, with_parts


def sessionize(events: DataFrame, key: str, ts: str, gap_seconds: int, record: Sequence[str] = (), chunk_seconds: int = 86_400, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(key, start_us, end_us, duration_us, n_events), one row per session.

    A pause of more than ``gap_seconds`` divides sessions; a pause of exactly that length does not. Rows with
    a null key or time belong to no session. ``record`` names the columns that identify a record: rows that
    agree in them, the key and the time count once; without it every row counts. Late and unordered rows
    need nothing special, ties merge into one session. An empty table gives no sessions. Other columns of
    ``events``, whatever their names, are not read. ``chunk_seconds`` and ``rows_per_task`` only steer the
    parallelism.
    """
    gap_us, chunk_us = gap_seconds * 1_000_000, chunk_seconds * 1_000_000
    base = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("k"), micros(ts).alias("s"), *[F.col(c).alias(f"r{i}") for i, c in enumerate(record)]
    )
    base = base.withColumn("c", F.expr(f"s div {chunk_us}"))
    base = with_parts(base, ["k", "c"], hot_groups(base, ["k", "c"], rows_per_task))
    # equal records share a hash and so a part; without a record events of one microsecond do
    part = F.when(F.col("parts__") > 1, F.pmod(F.xxhash64("s", *[f"r{i}" for i in range(len(record))]), F.col("parts__"))).otherwise(0)
    base = base.withColumn("part", part.cast("int")).drop("parts__")
    base = base.repartition("k", "c", "part")  # the only shuffle of events: the distinct and the first round keep to it
    if record:
        base = base.distinct()
    first = (
        base.withColumn("at", F.timestamp_micros("s"))
        .groupBy("k", "c", "part", F.session_window("at", f"{gap_us} microseconds").alias("w"))
        .agg(F.min("s").alias("s"), F.max("s").alias("e"), F.count(F.lit(1)).alias("n"))
    )
    length = F.concat((F.col("e") - F.col("s") + F.lit(gap_us)).cast("string"), F.lit(" microseconds"))
    merged = (
        first.select("k", "s", "e", "n", F.timestamp_micros("s").alias("at"))
        .groupBy("k", F.session_window("at", length).alias("w"))
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"))
    )
    return merged.select(
        F.col("k").alias(key), F.col("s").alias("start_us"), F.col("e").alias("end_us"), (F.col("e") - F.col("s")).alias("duration_us"), F.col("n").alias("n_events")
    )
