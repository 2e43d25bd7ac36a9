"""Reputation features from activity with an impact, from ratings, and from score histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.features.common import finish
from rookery.features.gaps import with_gaps
from rookery.functions.safe import count_if, sdiv


def activity_reputation(activity: DataFrame, responses: Sequence[str] = ("response",), collaboration: Sequence[str] = ("reply", "mention", "reaction")) -> DataFrame:
    """Reputation from (fid, id, activity_type, timestamp, impact_score).

    The mean impact of an account is needed per row (which rows lie above it); it is joined back from one row
    per account. Counts per type come from one grouping of (account, type).
    """
    base = activity.where("fid IS NOT NULL")
    mean = base.groupBy("fid").agg(F.avg("impact_score").alias("mean__"), F.stddev_samp("impact_score").alias("sd__"))
    g = with_gaps(base, "fid", "timestamp", "id").join(mean, "fid")
    above = F.col("impact_score") > F.col("mean__")
    a = g.groupBy("fid").agg(
        F.count(F.lit(1)).alias("n"),
        F.first("mean__").alias("peer_reputation"),
        F.first("sd__").alias("sd"),
        count_if(above).alias("above"),
        F.avg(F.when(above, F.col("impact_score"))).alias("value_generation"),
        F.stddev_samp("gap_h").alias("gap_sd"),
        F.avg("gap_h").alias("gap_mean"),
        F.stddev_samp(F.when(above, F.col("gap_h"))).alias("pattern_reliability"),
        F.avg(F.when(F.col("activity_type").isin(*responses), F.col("impact_score"))).alias("response_quality"),
        F.avg(F.when(F.col("activity_type").isin(*collaboration), F.col("impact_score"))).alias("collaboration_score"),
        count_if(F.col("impact_score") < 0).alias("negative"),
    )
    kinds = base.where("activity_type IS NOT NULL").groupBy("fid", "activity_type").agg(F.count(F.lit(1)).alias("k"), F.sum("impact_score").alias("impact"))
    k = kinds.groupBy("fid").agg(F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("typed"), F.stddev_samp("k").alias("k_sd"), F.avg("k").alias("k_mean"), count_if(F.col("k") == 1).alias("rare"), (F.sum(F.col("k") * F.col("k")) / F.sum("k")).alias("k_row_mean"), F.sum(F.col("k") * F.col("impact")).alias("weighted"))
    x = a.join(k, "fid", "left")
    return finish(
        x.select(
            "fid",
            "peer_reputation",
            F.col("peer_reputation").alias("participation_quality"),
            sdiv("weighted", "n").alias("contribution_score"),
            sdiv("above", "n").alias("authority_score"),
            sdiv("sd", "peer_reputation").alias("community_standing"),
            sdiv("sd", "peer_reputation").alias("activity_authenticity"),
            sdiv("gap_sd", "gap_mean").alias("behavior_consistency"),
            "pattern_reliability",
            "response_quality",
            sdiv("k_sd", "k_mean").alias("communication_style"),
            "collaboration_score",
            "value_generation",
            sdiv("kinds", "typed").alias("adaptability_score"),
            (1 - sdiv("negative", "n")).alias("resilience_metric"),
            sdiv("rare", "kinds").alias("innovation_index"),
            (F.col("peer_reputation") * F.col("k_row_mean")).alias("potential_score"),
        )
    )


def rated_engagement(ratings: DataFrame) -> DataFrame:
    """Quality, impact and interaction value from (fid, engagement_rate, quality_score)."""
    a = ratings.where("fid IS NOT NULL").groupBy("fid").agg(
        F.avg("quality_score").alias("engagement_quality"), F.avg(F.col("engagement_rate") * F.col("quality_score")).alias("content_impact"), F.avg(sdiv("quality_score", "engagement_rate")).alias("interaction_value")
    )
    return finish(a)


def score_history(scores: DataFrame, order: Sequence[str] = ("created_at",)) -> DataFrame:
    """Last, mean, deviation, range and trend of an account's scores over time; a null score counts as 0."""
    o = F.struct(*order)
    s = scores.where("fid IS NOT NULL").withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    a = s.groupBy("fid").agg(
        F.max_by("score", o).alias("last_score"),
        F.min_by("score", o).alias("first"),
        F.avg("score").alias("avg_score"),
        F.stddev_samp("score").alias("score_std"),
        (F.max("score") - F.min("score")).alias("score_range"),
    )
    a = a.withColumns({"score_trend": F.col("last_score") - F.col("first"), "relative_trend": sdiv(F.col("last_score") - F.col("first"), "first")})
    return finish(a.drop("first"))


def score_divergence(history: DataFrame, authenticity: DataFrame) -> DataFrame:
    """Distance of the last score from the authenticity score (fid, authenticity_score)."""
    j = history.join(authenticity, "fid")
    d = F.col("last_score") - F.col("authenticity_score")
    return finish(j.select("fid", F.abs(d).alias("score_divergence"), (d / (F.col("authenticity_score") + 1e-6)).alias("relative_score_diff")))


def authenticity(profile: DataFrame, counters: DataFrame, updates: DataFrame) -> DataFrame:
    """Weighted authenticity from profile, follower balance and the regularity of updates; missing parts are 0."""
    j = profile.select("fid", "has_bio", "has_avatar", "has_ens", "verification_count").join(counters.select("fid", "follower_count", "following_count"), "fid", "left").join(updates, "fid", "left")
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    whole = (z("has_bio") + z("has_avatar") + z("has_ens") + (z("verification_count") > 0).cast("int")) / 4
    f, g = z("following_count"), z("follower_count")
    balance = F.coalesce(1 - sdiv(F.abs(f - g), f + g), F.lit(0.0))
    natural = F.when(z("updates_count") > 0, 1 - F.least(F.greatest(z("updates_consistency"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return finish(j.select("fid", balance.alias("network_balance"), natural.alias("update_naturalness"), (0.4 * whole + 0.3 * balance + 0.3 * natural).alias("authenticity_score")))


def profile_details(profiles: DataFrame) -> DataFrame:
    """How many of url and location an account gives, and how old its profile is in hours, over its versions."""
    a = profiles.where("fid IS NOT NULL").groupBy("fid").agg(
        (F.max(F.col("url").isNotNull().cast("int")) + F.max(F.col("location").isNotNull().cast("int"))).alias("additional_profile_fields"),
        F.timestamp_diff("HOUR", F.min("created_at"), F.max("updated_at")).alias("profile_age_hours"),
        F.max(F.col("location").isNotNull().cast("int")).alias("has_location_info"),
    )
    return finish(a)


def channels_followed(follows: DataFrame, members: DataFrame) -> DataFrame:
    """Channels an account follows (fid, id, channel_id, timestamp, deleted_at) and belongs to (fid, channel_id, deleted_at)."""
    g = with_gaps(follows.where("deleted_at IS NULL"), "fid", "timestamp", "id")
    a = g.groupBy("fid").agg(F.count_distinct("channel_id").alias("unique_channels_followed"), count_if(F.col("gap_s") < 60).alias("rapid_channel_follows"))
    hours = g.groupBy("fid", F.hour("timestamp").alias("h")).agg(F.count(F.lit(1)).alias("n")).groupBy("fid").agg(F.stddev_samp("n").alias("channel_follow_hour_std"))
    m = members.where("deleted_at IS NULL AND fid IS NOT NULL").groupBy("fid").agg(F.count(F.lit(1)).alias("channel_memberships"), F.count_distinct("channel_id").alias("unique_channel_memberships"))
    j = a.join(hours, "fid", "left").join(m, "fid", "full").na.fill(0)
    return finish(
        j.withColumns({"channel_follow_burst_ratio": sdiv("rapid_channel_follows", F.col("unique_channels_followed") + 1), "channel_engagement_ratio": sdiv("channel_memberships", F.col("unique_channel_memberships") + 1)})
    )


def address_scores(addresses: DataFrame, scores: DataFrame) -> DataFrame:
    """(fid, score): the greatest score of any of an account's addresses (fid, addresses array) in (recipient, score).

    Accounts without addresses or scores keep a null score.
    """
    x = addresses.select("fid", F.explode_outer("addresses").alias("recipient")).distinct()
    best = scores.where("recipient IS NOT NULL").groupBy("recipient").agg(F.max("score").alias("score"))
    return x.join(best, "recipient", "left").groupBy("fid").agg(F.max("score").alias("score"))


def latest_names(history: DataFrame) -> DataFrame:
    """(fid, fname): the name an account took last; of names taken at one moment the greatest."""
    return history.where("fid IS NOT NULL").groupBy("fid").agg(F.max_by("fname", F.struct("updated_at", "fname")).alias("fname"))


def rank_in_group(df: DataFrame, group: str, by: str, key: str) -> DataFrame:
    """``df`` with rank inside a group, greatest first, ties by key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), key)))
