"""Feature formulas on small tables with values worked out by hand, independent of the SQL twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rookery.features import content, identity, network, reputation
from rookery.sources import views as V

T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def one(df, fid=1):
    return next(r.asDict() for r in df.collect() if r["fid"] == fid)


CASTS = [  # id, fid, text, deleted, parent_hash, mentions
    (1, 1, "a b a.", None, b"p", "[5,6]"),
    (2, 1, "see https://x.y @bob", None, None, "[]"),
    (3, 1, "a b a.", None, None, None),
    (4, 1, None, None, b"q", "[7]"),
    (5, 1, "!!!! $5 gone https://z", T0, b"r", "[1,2,3]"),
    (6, 1, "wait... for -- airdrop", None, None, "broken"),
]


@pytest.fixture(scope="module")
def casts(spark):
    return spark.createDataFrame(CASTS, "id bigint, fid bigint, text string, deleted_at timestamp_ntz, parent_hash binary, mentions string")


def test_content_of_live_posts_with_text(casts):
    r = one(content.texts(casts))
    assert (r["cast_count"], r["reply_count"], r["mention_count"]) == (4, 1, 1)
    assert r["link_usage_rate"] == 0.25 and r["hashtag_usage"] == 0.25
    assert r["avg_cast_length"] == (6 + 20 + 6 + 22) / 4
    # distinct words: 3 (a, b, a.), 3, 3, 4; the post without a text has none
    assert r["vocabulary_richness"] == (3 + 3 + 3 + 4 + 0) / 5
    assert r["content_type_diversity"] == round((3 / 4 + 3 / 4 + 3 / 4 + 4 / 5) / 4, 6)
    # distinct texts: three and the missing one
    assert (r["content_originality"], r["content_uniqueness"]) == (4 / 4, 4 / 5)


def test_mentions_of_live_posts_with_text(casts):
    r = one(content.mentions(casts))
    assert (r["total_mentions"], r["casts_with_mentions"]) == (2, 1)
    assert (r["avg_mentions_per_cast"], r["mention_frequency"]) == (0.5, 0.25)
    # runs of _ . - count, those of ! $ @ # % do not; the deleted post is out
    assert (r["symbol_spam_ratio"], r["price_mention_ratio"], r["airdrop_term_ratio"]) == (0.25, 0.0, 0.25)


def reactions(spark):
    rows = [(2, 1, None), (2, 1, None), (3, 1, None), (4, 1, T0), (1, 2, None), (1, 3, None), (1, 3, None), (2, None, None)]
    return spark.createDataFrame(rows, "fid bigint, target_fid bigint, deleted_at timestamp_ntz")


def history(spark):
    rows = [(1, 9, 4, T0, 1), (1, 4, 3, T0 + H, 2), (3, 0, 1, T0, 1)]
    return spark.createDataFrame(rows, "fid bigint, follower_count bigint, following_count bigint, created_at timestamp_ntz, export_ts bigint")


def test_reactions_received(spark, casts):
    r = one(content.received(reactions(spark), casts, history(spark)))
    assert (r["reactions_received"], r["unique_reactors"]) == (3, 2)
    assert (r["content_virality"], r["influence_per_cast"]) == (3 / 5, 2 / 5)
    assert (r["weighted_engagement_quality"], r["content_sustainability"]) == (3 / 5, 1.0)
    assert r["audience_retention"] == 2 / (4 + 1)
    assert r["content_effectiveness"] == round(0.3 * 0.6 + 0.3 * 0.6 + 0.2 + 0.2 * 0.4, 6)
    single = one(content.received(reactions(spark), casts.where("id = 2"), history(spark)))
    assert (single["content_virality"], single["content_sustainability"], single["content_effectiveness"]) == (3.0, 0.0, 0.0)


def test_engagement(spark, casts):
    members = spark.createDataFrame([(1, None), (1, None), (1, T0)], "fid bigint, deleted_at timestamp_ntz")
    e = content.engagement(casts, reactions(spark), history(spark), members)
    r = one(e)
    # 5 live posts, 3 live reactions to 2 accounts, 2 memberships, last counters 4 and 3
    assert r["engagement_score"] == round((5 + 3 + 2) / 3, 6)
    assert (r["engagement_rate"], r["audience_reach"], r["reach_metrics"], r["engagement_impact"]) == (3 / 5, 2 / 5, 2, 3 / 5)
    assert (r["creation_consumption_ratio"], r["interaction_diversity"]) == (5 / 4, 2 / 4)
    assert r["influence_score"] == round((0.4 * 4 + 0.3 * 3 + 0.3 * 5) / 4, 6)
    # live reactions by account: 3, 3 and 1
    totals = [3, 3, 1]
    mean = sum(totals) / 3
    sd = (sum((x - mean) ** 2 for x in totals) / 2) ** 0.5
    assert r["engagement_consistency"] == round(sd / (mean + 1), 6) == one(e, 3)["engagement_consistency"]


def test_verifications_and_trust(spark):
    rows = [(1, 1, '{"ethSignature":"0x1"}', "x", T0, None), (2, 1, '{"other":1}', "y", T0 + 2 * H, None), (3, 1, '{"ethSignature":"0x1"}', "x", T0 + 30 * H, None), (4, 1, '{"ethSignature":"0x2"}', "z", T0, T0)]
    v = identity.verification(spark.createDataFrame(rows, "id int, fid bigint, claim string, platform string, timestamp timestamp_ntz, deleted_at timestamp_ntz"))
    r = one(v)
    assert (r["total_verifications"], r["eth_verifications"], r["platforms_verified"], r["platform_diversity"], r["verification_velocity"]) == (3, 2, 2, 2, 3)
    assert (r["avg_hours_between_verifications"], r["verification_gaps"], r["verification_span_days"]) == (15.0, 1, 1)
    t = one(identity.trust(v))
    assert (t["verification_strength"], t["credibility_score"], t["spam_resistance"]) == (6.0, round(2 / 3, 6), 0.75)


def test_following_and_pace(spark):
    rows = [(1, 5, T0, T0, None), (1, 6, T0 + 2 * H, T0 + 2 * H, None), (1, 6, T0 + 6 * H, T0 + 6 * H, None), (2, 1, T0, T0, None)]
    f = network.following(spark.createDataFrame(rows, "fid bigint, target_fid bigint, timestamp timestamp_ntz, created_at timestamp_ntz, deleted_at timestamp_ntz"))
    r = one(f)
    assert (r["network_reach"], r["network_diversity"], r["network_centrality"]) == (2, 2, 5)
    assert (r["community_embedding"], r["network_volatility"]) == (round(2 / 3, 6), round(2**0.5, 6))
    assert r["follow_velocity"] == 3 / 3
    x = one(network.velocity(f))
    assert x["follow_velocity_log"] == round(0.6931471805599453, 6) and x["follow_velocity_capped"] == 0.99
    c = one(network.counters(history(spark)))
    assert (c["network_quality"], c["growth_trajectory"]) == (4 / 4, round((4 - 9) / 9, 6))


def test_reputation_of_activity(spark):
    rows = [(1, 1, "a", T0, 2.0), (1, 2, "a", T0 + H, 4.0), (1, 3, "b", T0 + 2 * H, 6.0)]
    r = one(reputation.activity_reputation(spark.createDataFrame(rows, "fid bigint, id int, activity_type string, timestamp timestamp_ntz, impact_score double")))
    assert (r["participation_quality"], r["contribution_score"]) == (4.0, (2 * 2 + 4 * 2 + 6 * 1) / 3)


def test_urls_reacted_to(spark):
    rows = [(1, "u", None), (1, "u", None), (1, None, None), (1, "v", T0), (None, "w", None)]
    assert one(network.link_diversity(spark.createDataFrame(rows, "fid bigint, target_url string, deleted_at timestamp_ntz")))["target_url_diversity"] == 2


def test_stand_ins_have_real_values(spark):
    from harness import DATA

    d = f"{DATA}/sf0.001"
    assert V.verifications(spark, d).where(F.col("claim").contains("ethSignature")).count() > 0
    assert reputation.profile_details(V.profile_versions(spark, d)).where("profile_age_hours > 0").count() > 0
    s = V.attested_scores(spark, d)
    assert s.count() > 0 and s.where("length(recipient) <> 40").count() == 0
