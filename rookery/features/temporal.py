"""Temporal behaviour of an account's posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.features.common import array_distinct_count, array_entropy, array_std, finish, histogram_of
from rookery.features.gaps import nearest_quantiles, with_gaps, with_running_count
from rookery.functions.safe import count_if, sdiv
from rookery.functions.timex import iso_weekday


def timing(casts: DataFrame, weekend: Sequence[int] = (5, 6)) -> DataFrame:
    """When the account posts: hours, weekdays, entropy, and pauses; deleted posts included.

    Hours and weekdays are counted as 24 and 7 conditional counts of one grouping, from which diversity,
    entropy and ratios follow without a second one. ``weekend`` are ISO weekdays; (6, 7) is the usual one.
    """
    g = with_gaps(casts, "fid", "timestamp", "id")
    h, wd = F.hour("timestamp"), iso_weekday("timestamp")
    a = g.groupBy("fid").agg(
        F.count(F.lit(1)).alias("n"),
        histogram_of(h, range(24)).alias("hours"),
        histogram_of(wd, range(1, 8)).alias("days"),
        count_if(F.col("gap_h") > 24).alias("inactive_periods"),
        F.stddev_samp("gap_h").alias("temporal_consistency"),
        count_if(F.col("gap_h") < 1).alias("near"),
        count_if(h.between(9, 22)).alias("prime"),
        count_if(wd.isin(*weekend)).alias("weekend"),
    )
    q = nearest_quantiles(g, "fid", "gap_h", (0.1, 0.9))
    out = a.join(q, "fid", "left").select(
        "fid",
        array_distinct_count("hours").alias("hour_diversity"),
        array_distinct_count("hours").alias("daily_active_hours"),
        array_distinct_count("hours").alias("rhythm_score"),
        array_distinct_count("days").alias("weekday_diversity"),
        array_std("hours").alias("hour_count_std"),
        "inactive_periods",
        "temporal_consistency",
        (F.col("q90") - F.col("q10")).alias("variability_index"),
        sdiv("prime", "n").alias("prime_time_ratio"),
        (1 - sdiv("prime", "n")).alias("off_hours_activity"),
        sdiv("weekend", "n").alias("weekend_activity_ratio"),
        sdiv(array_distinct_count("hours"), 24).alias("global_reach"),
        array_entropy("hours").alias("activity_entropy"),
        sdiv("near", "n").alias("temporal_clustering"),
    )
    return finish(out)


def patterns(casts: DataFrame) -> DataFrame:
    """Latency and bursts of the account's live posts; a burst is a gap of less than five minutes."""
    g = with_gaps(casts.where("deleted_at IS NULL"), "fid", "timestamp", "id")
    burst = F.col("gap_m") < 5
    a = g.groupBy("fid").agg(
        F.avg("gap_s").alias("avg_follow_latency_seconds"),
        F.count(F.lit(1)).alias("posting_frequency"),
        F.avg("gap_h").alias("response_latency"),
        F.stddev_samp("gap_h").alias("interaction_timing"),
        count_if(F.col("gap_h") < 1).alias("engagement_windows"),
        count_if(burst).alias("burst_frequency"),
        F.avg(F.when(burst, F.col("gap_m"))).alias("burst_duration"),
        F.avg(F.when(~burst, F.col("gap_m"))).alias("inter_burst_interval"),
    )
    b = F.col("burst_frequency")
    return finish(a.withColumns({"burst_intensity": sdiv(b, b + 1), "burst_engagement_ratio": sdiv(b, "posting_frequency"), "burst_impact": b}))


def channels(casts: DataFrame) -> DataFrame:
    """Channels of the account's live posts; the ratio is over all of them, with or without a channel."""
    a = casts.where("deleted_at IS NULL").groupBy("fid").agg(F.count_distinct("parent_url").alias("unique_channels"), F.count("parent_url").alias("c"), F.count(F.lit(1)).alias("n"))
    return finish(a.select("fid", "unique_channels", sdiv("unique_channels", "c").alias("cross_channel_activity"), sdiv("c", "n").alias("multi_channel_ratio")))


def trends(casts: DataFrame, width: int = 24, block: int = 20_000) -> DataFrame:
    """How steady the gaps are: mean rolling deviation, and deviation of the rolling mean's steps.

    Rows are numbered per account by calendar chunk, then cut into blocks of that numbering; each block is led
    by a copy of the ``width`` rows before it, which fill its first frames and are dropped. An account with any
    number of posts is so spread over blocks.
    """
    g = with_running_count(with_gaps(casts, "fid", "timestamp", "id"), "fid", "timestamp", "id", "timestamp", "i")
    at = F.col("i") - 1
    own = F.floor(at / block)
    lead = F.when(at % block >= block - width, own + 1)
    x = g.select("fid", "i", "gap_h", own.alias("own"), F.explode(F.array_compact(F.array(own, lead))).alias("b"))
    w = Window.partitionBy("fid", "b").orderBy("i")
    roll = w.rowsBetween(-(width - 1), 0)
    x = x.withColumn("sd", F.stddev_samp("gap_h").over(roll)).withColumn("mean", F.avg("gap_h").over(roll))
    x = x.withColumn("step", F.col("mean") - F.lag("mean").over(w)).where("b = own")
    return finish(x.groupBy("fid").agg(F.avg("sd").alias("trend_stability"), F.stddev_samp("step").alias("adaptation_rate")))


def activity(events: DataFrame) -> DataFrame:
    """Pace of all of an account's actions (fid, id, timestamp), whatever their kind."""
    g = with_gaps(events, "fid", "timestamp", "id")
    a = g.groupBy("fid").agg(
        F.count(F.lit(1)).alias("total_activity"),
        F.avg("gap_h").alias("avg_hours_between_actions"),
        F.stddev_samp("gap_h").alias("std_hours_between_actions"),
        F.stddev_samp(iso_weekday("timestamp")).alias("weekday_variance"),
        count_if(F.col("gap_h") < 1).alias("rapid_actions"),
        count_if(F.col("gap_h") > 24).alias("long_gaps"),
        count_if(F.col("gap_m") < 5).alias("actions_in_bursts"),
        F.timestamp_diff("HOUR", F.min("timestamp"), F.max("timestamp")).alias("time_span"),
        count_if(F.col("gap_s") < 2).alias("rapid_action_count"),
        F.coalesce(F.stddev_samp("gap_s") < 1, F.lit(False)).cast("int").alias("has_robotic_timing"),
        F.avg(F.when(F.col("gap_m") < 5, F.col("gap_s"))).alias("avg_burst_interval"),
    )
    q = nearest_quantiles(g, "fid", "gap_h", (0.1, 0.9)).withColumnsRenamed({"q10": "p10_time_between_actions", "q90": "p90_time_between_actions"})
    out = a.join(q, "fid", "left").withColumns(
        {
            "burst_activity_ratio": sdiv("actions_in_bursts", "total_activity"),
            "activity_spread": sdiv("time_span", "total_activity"),
            "temporal_irregularity": sdiv("std_hours_between_actions", F.col("avg_hours_between_actions") + 1),
            "follow_velocity": sdiv("total_activity", F.col("time_span") + 1),
        }
    )
    return finish(out)


def rhythm(events: DataFrame) -> DataFrame:
    """Deviation of the hourly and of the weekday counts of all actions, and their number."""
    live = events.where("timestamp IS NOT NULL")
    a = live.groupBy("fid").agg(histogram_of(F.hour("timestamp"), range(24)).alias("h"), histogram_of(iso_weekday("timestamp"), range(1, 8)).alias("d"), F.count(F.lit(1)).alias("total_activities"))
    return finish(a.select("fid", array_std("h").alias("hour_std"), array_std("d").alias("weekday_std"), "total_activities"))


def intervals(df: DataFrame, key: str, ts: str, tie: str, name: str) -> DataFrame:
    """Number of rows per key, mean and deviation of the hours between them, quick repeats and long pauses.

    The one shape behind signers, verifications, platform verifications, profile updates and replies.
    """
    g = with_gaps(df.withColumnRenamed(key, "fid") if key != "fid" else df, "fid", ts, tie)
    a = g.groupBy("fid").agg(
        F.count(F.lit(1)).alias(f"{name}_count"),
        F.avg("gap_h").alias(f"avg_hours_between_{name}"),
        F.stddev_samp("gap_h").alias(f"std_hours_between_{name}"),
        count_if(F.col("gap_h") < 1).alias(f"sequential_{name}"),
        count_if(F.col("gap_h") > 24).alias(f"{name}_gaps"),
    )
    return finish(a.withColumn(f"{name}_consistency", sdiv(f"std_hours_between_{name}", F.col(f"avg_hours_between_{name}") + 1)))
