"""Gaps between an account's successive events, computed once and without one task per account."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.timex import gap
from rookery.operators.skew import CHUNK, ROWS_PER_TASK, time_chunks


def with_gaps(df: DataFrame, key: str, ts: str, tie: str, chunk: str = "month", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` with prev_ts, gap_s, gap_m and gap_h: whole units since the account's event before, null for the first.

    Order is (ts, tie). Rows with a null key or time have no place in it and are dropped. The look-back runs
    inside (key, chunk of time); only the first event of a chunk takes the last time of the key's chunk before,
    from a summary with one row per key and chunk. Chunks are calendar spans, and those of them with too many
    rows are cut where their counted rows reach equal shares, so a busy account is divided even within a day.
    """
    live = time_chunks(df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()), key, ts, chunk, rows_per_task).repartition(key, *CHUNK)
    w = Window.partitionBy(key, *CHUNK).orderBy(ts, tie)
    ends = live.groupBy(key, *CHUNK).agg(F.max(ts).alias("end__"))
    before = _at(key, ends, F.lag("end__").over(Window.partitionBy(key).orderBy(*CHUNK)))
    out = _joined(key, live.withColumn("lag__", F.lag(ts).over(w)), before)
    out = out.withColumn("prev_ts", F.coalesce("lag__", "before__")).drop("lag__", "before__")
    units = {"gap_s": "SECOND", "gap_m": "MINUTE", "gap_h": "HOUR"}
    return out.withColumns({c: gap(u, F.col("prev_ts"), F.col(ts)) for c, u in units.items()})


def with_running_count(df: DataFrame, key: str, ts: str, tie: str, counted: str, out: str, chunk: str = "month", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` with the number of non-null values of ``counted`` up to and including each row, by key in order of (ts, tie).

    Null times come first. Runs inside (key, chunk of time), see :func:`with_gaps`, with the count of the chunks
    before added from one summary row per key and chunk; rows with a null key are dropped.
    """
    live = time_chunks(df.where(F.col(key).isNotNull()), key, ts, chunk, rows_per_task).repartition(key, *CHUNK)
    upto = Window.partitionBy(key, *CHUNK).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    per = live.groupBy(key, *CHUNK).agg(F.count(counted).alias("n__"))
    earlier = Window.partitionBy(key).orderBy(*CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = _at(key, per, F.coalesce(F.sum("n__").over(earlier), F.lit(0)))
    x = _joined(key, live.withColumn("own__", F.count(counted).over(upto)), before)
    return x.withColumn(out, F.col("own__") + F.col("before__")).drop("own__", "before__")


def _at(key: str, per_chunk: DataFrame, value: Column) -> DataFrame:
    return per_chunk.select(F.col(key).alias("k__"), *[F.col(c).alias(f"at_{c}") for c in CHUNK], value.alias("before__"))


def _joined(key: str, rows: DataFrame, before: DataFrame) -> DataFrame:
    """``rows`` with before__ of their chunk and without the chunk."""
    on = F.col(key) == F.col("k__")
    for c in CHUNK:
        on = on & (F.col(c) == F.col(f"at_{c}"))
    return rows.join(before, on).drop("k__", *CHUNK, *[f"at_{c}" for c in CHUNK])


def nearest_quantiles(df: DataFrame, key: str, value: str, qs: Sequence[float]) -> DataFrame:
    """(key, q<percent> ...): the order statistics at round((n - 1) q) of a whole-numbered value, nulls left out.

    Values are counted per (key, value) first, with partial aggregation, and ranks come from running counts
    over distinct values, so no account's values are gathered in one place.
    """
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    at = lambda q: F.round((F.col("total") - 1) * F.lit(float(q))) + 1
    return ranked.groupBy(key).agg(*[F.min(F.when(F.col("upto") >= at(q), F.col("v"))).alias(f"q{round(q * 100)}") for q in qs])
