"""Profile, verification and storage features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.features.common import finish
from rookery.features.gaps import with_gaps
from rookery.functions.safe import clip, count_if, nunique, sdiv
from rookery.functions.text import address_list, char_diversity, has

_FLAGS = ("random_numbers", "wallet_pattern", "excessive_symbols", "airdrop_terms", "has_year")


def profile(profiles: DataFrame) -> DataFrame:
    """Completeness and name patterns of each profile, by account; of several rows the greatest value counts."""
    flag = lambda c: c.cast("bigint")
    x = profiles.select(
        "fid",
        flag(has("ens", "fname")).alias("has_ens"),
        *[flag(F.col(c).isNotNull()).alias(a) for c, a in (("bio", "has_bio"), ("avatar_url", "has_avatar"), ("display_name", "has_display_name"))],
        F.char_length("display_name").cast("bigint").alias("display_name_length"),
        F.char_length("bio").cast("bigint").alias("bio_length"),
        *[flag(has(p, c)).alias(f"{c}_{p}") for c in ("fname", "bio") for p in _FLAGS],
        char_diversity("fname").alias("fname_entropy"),
        char_diversity("bio").alias("bio_entropy"),
        F.when(F.col("verified_addresses").contains(","), 2).when(F.col("verified_addresses") != "[]", 1).otherwise(0).cast("bigint").alias("verification_count"),
        F.size(address_list("verified_addresses")).cast("bigint").alias("verification_count_exact"),
    )
    x = x.withColumn("profile_completeness", sdiv(F.col("has_bio") + F.col("has_avatar") + F.col("has_ens") + F.col("has_display_name"), 4))
    return finish(x.groupBy("fid").agg(*[F.max(c).alias(c) for c in x.columns if c != "fid"]))


def profile_authenticity(p: DataFrame) -> DataFrame:
    """1 less a fifth for each suspicious pattern of the result of :func:`profile`."""
    bad = F.col("fname_random_numbers") + F.col("fname_wallet_pattern") + F.col("fname_airdrop_terms") + F.col("bio_airdrop_terms") + F.col("bio_wallet_pattern")
    return p.select("fid", F.round(1 - 0.2 * bad.cast("double"), 6).alias("profile_authenticity"))


def verification(verifications: DataFrame) -> DataFrame:
    """Live verifications per account (claim is JSON, platform the kind of account): number, kinds, pace and span."""
    g = with_gaps(verifications.where("deleted_at IS NULL"), "fid", "timestamp", "id")
    a = g.groupBy("fid").agg(
        F.count(F.lit(1)).alias("total_verifications"),
        count_if(F.col("claim").contains("ethSignature")).alias("eth_verifications"),
        F.avg("gap_h").alias("avg_hours_between_verifications"),
        F.stddev_samp("gap_h").alias("verification_timing_std"),
        count_if(F.col("gap_h") < 1).alias("sequential_verifications"),
        count_if(F.col("gap_h") > 24).alias("verification_gaps"),
        F.count_distinct("platform").alias("platforms_verified"),
        F.count_distinct("platform").alias("platform_diversity"),
        F.count("platform").alias("verification_velocity"),
        nunique("claim").alias("claim_kinds"),
        F.timestamp_diff("DAY", F.min("timestamp"), F.max("timestamp")).alias("verification_span_days"),
    )
    a = a.withColumn("verification_consistency", sdiv("verification_timing_std", F.col("avg_hours_between_verifications") + 1))
    return finish(a)


def trust(v: DataFrame) -> DataFrame:
    """Trust measures from the number of verifications and kinds of claim (the result of :func:`verification`)."""
    c, p = F.col("total_verifications").cast("double"), F.col("claim_kinds").cast("double")
    return finish(
        v.select(
            "fid",
            (c * p).alias("verification_strength"),
            (p / 10).alias("identity_confidence"),
            (1 - 1 / (c + 1)).alias("spam_resistance"),
            clip(1 - sdiv(p, c), 0.0, 1.0).alias("abuse_likelihood"),
            sdiv(p, c).alias("credibility_score"),
            clip(c * p / 100, 0.0, 1.0).alias("reliability_index"),
        )
    )


def storage(purchases: DataFrame) -> DataFrame:
    """Live storage per account: level, growth from the first to the last purchase, stability and efficiency."""
    order = F.struct("timestamp", "id")
    a = purchases.where("deleted_at IS NULL").groupBy("fid").agg(
        F.avg("units").alias("storage_units"),
        F.max("units").alias("storage_utilization"),
        F.count(F.lit(1)).alias("storage_update_frequency"),
        (F.max_by("units", order) - F.min_by("units", order)).alias("storage_growth"),
        F.stddev_samp("units").alias("storage_stability"),
    )
    a = a.withColumns({"storage_efficiency": sdiv("storage_units", "storage_utilization"), "storage_growth_rate": sdiv("storage_growth", "storage_update_frequency")})
    calm = 1 - clip(F.coalesce("storage_growth_rate", F.lit(0.0)), 0.0, 1.0)
    return finish(a.withColumn("resource_utilization", 0.5 * F.col("storage_efficiency") + 0.3 * F.coalesce("storage_stability", F.lit(0.0)) + 0.2 * calm))


def identity_scores(p: DataFrame, v: DataFrame) -> DataFrame:
    """Weighted scores of profile and verification features; missing verifications count as 0."""
    j = p.join(v, "fid", "left")
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return finish(
        j.select(
            "fid",
            (0.4 * z("profile_completeness") + 0.3 * z("verification_consistency") + 0.3 * z("platforms_verified") / 5).alias("identity_strength"),
            (0.4 * z("platform_diversity") + 0.3 * z("verification_consistency") + 0.3 * F.coalesce(sdiv("eth_verifications", "total_verifications"), F.lit(0.0))).alias("verification_quality"),
        )
    )
