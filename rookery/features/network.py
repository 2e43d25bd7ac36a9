"""Features of the follow network, computed on the whole graph and restricted to accounts afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.features.common import finish
from rookery.features.gaps import with_gaps
from rookery.functions.safe import clip, count_if, nunique, scalars, sdiv


def degrees(edges: DataFrame, src: str = "fid", dst: str = "target_fid") -> DataFrame:
    """(fid, out_degree, unique_out_degree, in_degree, unique_in_degree) of every account on either end.

    Both directions come from one grouping over (account, other end) pairs: no distinct aggregate over a
    busy account, and no outer join.
    """
    ends = F.array(F.struct(F.col(src).alias("fid"), F.col(dst).alias("x"), F.lit(True).alias("out")), F.struct(F.col(dst).alias("fid"), F.col(src).alias("x"), F.lit(False).alias("out")))
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.explode(ends).alias("e")).groupBy("e.fid", "e.x", "e.out").agg(F.count(F.lit(1)).alias("n"))
    side = lambda out, c: F.coalesce(F.sum(F.when(F.col("out") == out, c)), F.lit(0))
    return pairs.groupBy("fid").agg(
        side(True, F.col("n")).alias("out_degree"), side(True, F.lit(1)).alias("unique_out_degree"), side(False, F.col("n")).alias("in_degree"), side(False, F.lit(1)).alias("unique_in_degree")
    )


def centrality(edges: DataFrame) -> DataFrame:
    """Degree-based centrality, bridging and clustering of every account on either end of an edge."""
    d = degrees(edges)
    top = scalars(d.agg((F.max("out_degree") + F.max("in_degree")).alias("top")))("top")
    o, i, uo, ui = (F.col(c) for c in ("out_degree", "in_degree", "unique_out_degree", "unique_in_degree"))
    both = (uo * ui).cast("double")
    x = d.withColumns(
        {"centrality_score": sdiv(o + i, top), "bridge_score": sdiv(both, o + i + 1), "clustering_coefficient": sdiv(both, (o + 1).cast("double") * (i + 1))}
    )
    return finish(x)


def reciprocity(edges: DataFrame) -> DataFrame:
    """Share of an account's distinct targets that follow back.

    One grouping of unordered pairs instead of a self-join: a pair with both directions is reciprocal, and a
    celebrity's pairs are spread by their other end.
    """
    a, b = F.least("fid", "target_fid"), F.greatest("fid", "target_fid")
    pairs = edges.where("fid IS NOT NULL AND target_fid IS NOT NULL AND fid <> target_fid").groupBy(a.alias("a"), b.alias("b"))
    pairs = pairs.agg(F.max((F.col("fid") < F.col("target_fid")).cast("int")).alias("up"), F.max((F.col("fid") > F.col("target_fid")).cast("int")).alias("down"))
    both = (F.col("up") + F.col("down") == 2).cast("int")
    sides = F.filter(F.array(F.struct(F.col("a").alias("fid"), F.col("up").alias("has")), F.struct(F.col("b").alias("fid"), F.col("down").alias("has"))), lambda s: s["has"] == 1)
    x = pairs.select(both.alias("both"), F.explode(sides).alias("s")).groupBy("s.fid").agg(F.sum("both").alias("reciprocal_count"), F.count(F.lit(1)).alias("following"))
    return finish(x.select("fid", "reciprocal_count", sdiv("reciprocal_count", "following").alias("follow_reciprocity")))


def following(follows: DataFrame) -> DataFrame:
    """Size, pace and stability of what an account follows; churn over all rows, the rest over live ones."""
    g = with_gaps(follows.where("deleted_at IS NULL"), "fid", "timestamp", "target_fid")
    a = g.groupBy("fid").agg(
        F.count("target_fid").alias("following_count"),
        F.count_distinct("target_fid").alias("unique_following"),
        F.timestamp_diff("HOUR", F.min("timestamp"), F.max("timestamp")).alias("network_age_hours"),
        F.avg("gap_h").alias("mean_gap"),
        F.stddev_samp("gap_h").alias("growth_stability"),
        F.avg(F.timestamp_diff("SECOND", F.col("timestamp"), F.col("created_at"))).alias("avg_follow_latency_seconds"),
    )
    churn = follows.groupBy("fid").agg(
        F.count(F.lit(1)).alias("total_follows"),
        count_if(F.col("deleted_at").isNotNull()).alias("deleted"),
        count_if(F.timestamp_diff("DAY", F.col("created_at"), F.coalesce("deleted_at", "timestamp")) > 30).alias("stable_connections"),
    )
    n, u = F.col("following_count"), F.col("unique_following")
    x = churn.join(a, "fid", "left").select(
        "fid",
        "following_count",
        "unique_following",
        "total_follows",
        "stable_connections",
        sdiv(n, u + 1).alias("follow_ratio"),
        "network_age_hours",
        sdiv(n, "mean_gap").alias("follow_velocity"),
        sdiv("total_follows", F.col("network_age_hours") + 1).alias("follow_rate_per_hour"),
        "growth_stability",
        "avg_follow_latency_seconds",
        sdiv(u, n).alias("network_density"),
        sdiv(u, n).alias("community_embedding"),
        u.alias("network_reach"),
        u.alias("network_diversity"),
        F.col("growth_stability").alias("network_volatility"),
        (n + u).alias("network_centrality"),
        sdiv("deleted", "total_follows").alias("network_churn_rate"),
        (1 - sdiv("deleted", "total_follows")).alias("follower_retention"),
    )
    return finish(x)


def counters(history: DataFrame) -> DataFrame:
    """First, last and growth of the follower counters, ordered by (created_at, export_ts), with scores of the last.

    Struct-ordered min_by and max_by replace a sort per account; steps need the order and use a window.
    """
    from pyspark.sql import Window

    o = F.struct("created_at", "export_ts")
    w = Window.partitionBy("fid").orderBy("created_at", "export_ts", "follower_count", "following_count")
    steps = history.withColumn("df", F.col("follower_count") - F.lag("follower_count").over(w)).withColumn("dg", F.col("following_count") - F.lag("following_count").over(w))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), o))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), o))
    a = steps.groupBy("fid").agg(
        last("follower_count").alias("follower_count"),
        last("following_count").alias("last_following"),
        first("follower_count").alias("f0"),
        first("following_count").alias("g0"),
        F.max("follower_count").alias("fm"),
        F.stddev_samp("df").alias("sf"),
        F.stddev_samp("dg").alias("sg"),
        F.avg("df").alias("mf"),
    )
    f, g = F.col("follower_count"), F.col("last_following")
    return finish(
        a.select(
            "fid",
            "follower_count",
            g.alias("following_count"),
            sdiv(f - F.col("f0"), "f0").alias("follower_growth_rate"),
            sdiv(f - F.col("f0"), "f0").alias("growth_trajectory"),
            sdiv(f, g + 1).alias("network_quality"),
            sdiv(g - F.col("g0"), "g0").alias("following_growth_rate"),
            (F.col("sf") + F.col("sg")).alias("network_growth_rate"),
            sdiv(f, g + 1).alias("influence_score"),
            sdiv(f, "f0").alias("activity_score"),
            sdiv(f + g, "fm").alias("counter_centrality"),
            (1 - sdiv(F.abs(f - g), f + g + 1)).alias("relationship_health"),
            (1 - sdiv("sf", "mf")).alias("sustainability_index"),
        )
    )


def ratios(d: DataFrame, cap: float = 0.99) -> DataFrame:
    """Log and capped follower ratios from :func:`degrees`; the cap is a percentile over all accounts."""
    x = d.select("fid", sdiv("in_degree", F.col("out_degree") + 1).alias("follower_ratio"), sdiv("unique_in_degree", F.col("unique_out_degree") + 1).alias("unique_follower_ratio"), "in_degree", "out_degree")
    caps = scalars(x.agg(F.percentile("follower_ratio", F.lit(cap)).alias("c1"), F.percentile("unique_follower_ratio", F.lit(cap)).alias("c2")))
    i, o = F.col("in_degree"), F.col("out_degree")
    return finish(
        x.select(
            "fid",
            "follower_ratio",
            F.log1p("follower_ratio").alias("follower_ratio_log"),
            F.log1p("unique_follower_ratio").alias("unique_follower_ratio_log"),
            F.greatest(F.least("follower_ratio", caps("c1")), F.lit(0.0)).alias("follower_ratio_capped"),
            F.greatest(F.least("unique_follower_ratio", caps("c2")), F.lit(0.0)).alias("unique_follower_ratio_capped"),
            (i > o).cast("int").alias("has_more_followers"),
            (1 - sdiv(F.abs(o - i), o + i + 1)).alias("follow_balance_ratio"),
            (1 - sdiv(F.abs(o - i), o + i + 1)).alias("follower_authenticity_score"),
        )
    )


def velocity(follows: DataFrame, cap: float = 0.99) -> DataFrame:
    """Log and capped pace of following, from (fid, follow_velocity) of :func:`following`; the cap is a percentile over all accounts."""
    top = scalars(follows.agg(F.percentile("follow_velocity", F.lit(cap)).alias("c")))("c")
    return finish(follows.select("fid", F.log1p("follow_velocity").alias("follow_velocity_log"), F.greatest(F.least("follow_velocity", top), F.lit(0.0)).alias("follow_velocity_capped")))


def link_diversity(reacts: DataFrame) -> DataFrame:
    """Distinct URLs an account's live reactions (fid, target_url, deleted_at) point to; no URL counts as one."""
    return finish(reacts.where("deleted_at IS NULL AND fid IS NOT NULL").groupBy("fid").agg(nunique("target_url").alias("target_url_diversity")))


def blocking(blocks: DataFrame) -> DataFrame:
    """Blocks an account made, of how many accounts, and how often repeatedly."""
    a = blocks.where("blocker_fid IS NOT NULL").groupBy(F.col("blocker_fid").alias("fid")).agg(F.count(F.lit(1)).alias("blocks_made"), F.count_distinct("blocked_fid").alias("unique_blocks"))
    return finish(a.withColumn("block_repeat_ratio", sdiv("blocks_made", F.col("unique_blocks") + 1)))


def influence_of_targets(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score of the accounts an account follows, and the share above that mean.

    ``scores`` is (fid, score). The mean and the share come from one grouping of (account, score) pairs.
    """
    from pyspark.sql import Window

    j = edges.select("fid", "target_fid").distinct().join(scores.select(F.col("fid").alias("target_fid"), "score"), "target_fid")
    w = Window.partitionBy("fid")
    x = j.groupBy("fid", "score").agg(F.count(F.lit(1)).alias("n")).withColumn("mean", F.sum(F.col("score") * F.col("n")).over(w) / F.sum("n").over(w))
    x = x.groupBy("fid").agg(F.max("mean").alias("influential_followers"), F.sum("n").alias("n"), F.sum(F.when(F.col("score") > F.col("mean"), F.col("n")).otherwise(0)).alias("above"))
    return finish(x.select("fid", "influential_followers", sdiv("above", "n").alias("influencer_ratio")))


def clipped(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """``df`` with one column clipped."""
    return df.withColumn(column, clip(column, lo, hi))
