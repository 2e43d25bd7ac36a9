"""Totals over trailing (or leading) periods for every entity and calendar day.

Events are reduced to daily totals; each entity gets a calendar of all its days; a range join brings to each
calendar day the daily totals within its bounds. Coarse date buckets make the range join an equi-join: a
daily total is copied into the few buckets whose days can see it, a calendar day lies in one bucket. Both
the join and the sums keep to the partitioning by (entity, bucket), in which no entity is large.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions.timex import day_number


def daily_totals(events: DataFrame, entity: str, ts: str, amount: str | None = None) -> DataFrame:
    """(e, day, n) of the days with activity; rows with a null entity or time are left out."""
    value = F.sum(F.coalesce(F.col(amount), F.lit(0))) if amount else F.count(F.lit(1))
    live = events.where(F.col(entity).isNotNull() & F.col(ts).isNotNull())
    return live.groupBy(F.col(entity).alias("e"), day_number(ts).alias("day")).agg(value.alias("n"))


def rolling_totals(daily: DataFrame, entity: str, windows: Mapping[str, tuple[int, int]], tail_days: int = 0, bucket_days: int = 30, today: str = "n") -> DataFrame:
    """(entity, day, <today>, <window> ...), one row for every calendar day of each entity.

    ``daily`` is the result of :func:`daily_totals`. The calendar of an entity runs from its first active day
    to ``tail_days`` after its last, inactive days included. ``windows`` maps a column to the first and last
    day of a period relative to the calendar day, both included: (-6, 0) are the 7 days that end with it.
    Periods that reach before the first event or past the last find nothing there and add 0. The column
    ``today`` is the day's own total. An empty table gives no rows.
    """
    lo, hi = min(0, *[w[0] for w in windows.values()]), max(0, *[w[1] for w in windows.values()])
    span = daily.groupBy("e").agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    calendar = span.select("e", F.explode(F.sequence("d0", F.col("d1") + tail_days)).alias("d")).withColumn("b", F.expr(f"CAST(floor(d / {bucket_days}) AS INT)"))
    seen = daily.select(
        F.col("e").alias("e2"),
        "day",
        "n",
        # days d with day in [d + lo, d + hi] are the days from day - hi to day - lo
        F.explode(F.expr(f"sequence(CAST(floor((day - {hi}) / {bucket_days}) AS INT), CAST(floor((day - {lo}) / {bucket_days}) AS INT))")).alias("b2"),
    )
    off = F.col("day") - F.col("d")
    joined = calendar.join(seen, (F.col("e") == F.col("e2")) & (F.col("b") == F.col("b2")) & off.between(lo, hi), "left")
    within = lambda a, z: F.coalesce(F.sum(F.when(off.between(a, z), F.col("n"))), F.lit(0).cast("bigint"))
    return (
        joined.groupBy("e", "b", "d")
        .agg(within(0, 0).alias(today), *[within(a, z).alias(name) for name, (a, z) in windows.items()])
        .select(F.col("e").alias(entity), F.date_from_unix_date("d").alias("day"), today, *windows)
    )
