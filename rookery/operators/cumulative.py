"""Per-entity feature tables from a store of cumulative daily counts.

The store holds one row per (entity, event type, day with activity) with the count, the total and the latest
time up to and including that day. A window that ends on any day then costs two as-of look-ups and a
subtraction, and no event is read again. Raw events are reduced to daily states on the map side first, so
busy entities are as cheap as quiet ones, and running sums are over days, not over events.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.timex import day_number

#: Day of events without a time: before every real day, so they count in totals and in no bounded window.
NO_DAY = -1_000_000


def cumulative_store(events: DataFrame, entity: str, event_type: str, ts: str, amount: str | None = None) -> DataFrame:
    """(entity, event_type, day, cum_n, cum_total, last_ts) with day in days since 1970-01-01.

    Rows with a null entity or type are left out; a null time counts in every total and has no recency; a
    null amount counts as 0. Every row of ``events`` is one event: the caller removes repeated deliveries.
    """
    day = F.coalesce(day_number(ts), F.lit(NO_DAY)).cast("int")
    value = F.coalesce(F.col(amount), F.lit(0)).cast("bigint") if amount else F.lit(1).cast("bigint")
    daily = (
        events.where(F.col(entity).isNotNull() & F.col(event_type).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(event_type).alias("event_type"), day.alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(ts).alias("last"))
    )
    w = Window.partitionBy("entity", "event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        "entity", "event_type", "day", F.sum("n").over(w).alias("cum_n"), F.sum("total").over(w).alias("cum_total"), F.max("last").over(w).alias("last_ts")
    )


def _as_of(value: str, day: Column) -> Column:
    """Aggregate: the value on the last stored day that is not after ``day``; 0 before the first."""
    return F.coalesce(F.max(F.when(F.col("day") <= day, F.col(value))), F.lit(0).cast("bigint"))


def type_features(store: DataFrame, as_of: Column | None = None, windows: Mapping[str, int] | None = None) -> DataFrame:
    """(entity, event_type, n, total, last_ts, n_<w>, total_<w> ...) as of a day; all of the store by default.

    ``windows`` maps a suffix to a length in days; the window ends with the day ``as_of``. Cumulative values
    never fall, so the as-of value is the greatest up to the end point and a plain hash aggregate finds it.
    Types that have no event up to ``as_of`` give no row.
    """
    end = as_of if as_of is not None else F.lit(2_000_000_000)
    aggs = [_as_of("cum_n", end).alias("n"), _as_of("cum_total", end).alias("total"), F.max(F.when(F.col("day") <= end, F.col("last_ts"))).alias("last_ts")]
    for name, days in (windows or {}).items():
        aggs += [(_as_of(f"cum_{x}", end) - _as_of(f"cum_{x}", end - F.lit(days))).alias(f"{x}_{name}") for x in ("n", "total")]
    return store.groupBy("entity", "event_type").agg(*aggs).where("n > 0")


def period_features(store: DataFrame, first: Column, last: Column) -> DataFrame:
    """(entity, event_type, n, total, last_ts) of the days from ``first`` to ``last``, both included.

    Counts and totals are what the store held as of ``last`` less what it held as of the day before ``first``;
    last_ts is the latest time in the period. Types without an event in it give no row. With
    ``first`` = NO_DAY the events without a time are among the period's.
    """
    before = first - F.lit(1)
    inside = (F.col("day") >= first) & (F.col("day") <= last)
    aggs = [(_as_of(f"cum_{x}", last) - _as_of(f"cum_{x}", before)).alias(a) for x, a in (("n", "n"), ("total", "total"))]
    return store.groupBy("entity", "event_type").agg(*aggs, F.max(F.when(inside, F.col("last_ts"))).alias("last_ts")).where("n > 0")


def feature_table(features: DataFrame, entity: str, max_types: int = 100_000) -> DataFrame:
    """One row per entity: ``types``, an array of the per-type features ordered by type, and totals over all.

    The array holds one entry per event type of the entity. Its length is bounded by ``max_types``: an entity
    with more types is an error and never a silently shortened or endless row.
    """
    cells = F.struct(*[c for c in features.columns if c != "entity"])
    n_types = F.col("n_types") + F.coalesce(F.when(F.col("n_types") > max_types, F.raise_error(F.lit(f"more than {max_types} event types"))).cast("bigint"), F.lit(0))
    return features.groupBy(F.col("entity").alias(entity)).agg(
        F.count(F.lit(1)).alias("n_types"), F.sum("n").alias("n_events"), F.sum("total").alias("total"), F.max("last_ts").alias("last_ts"), F.array_sort(F.collect_list(cells)).alias("types")
    ).withColumn("n_types", n_types)


def wide_features(features: DataFrame, entity: str, types: Sequence[str], values: Sequence[str] = ("n", "total", "last_ts")) -> DataFrame:
    """One row per entity and one column per (type, value), named ``<value>__<position of the type>``.

    Counts and totals of types an entity lacks are 0, times are null.
    """
    out = []
    for i, t in enumerate(types):
        for v in values:
            c = F.max(F.when(F.col("event_type") == t, F.col(v)))
            out.append((c if v == "last_ts" else F.coalesce(c, F.lit(0))).alias(f"{v}__{i}"))
    return features.groupBy(F.col("entity").alias(entity)).agg(*out)
