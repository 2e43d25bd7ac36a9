"""Properties the features must have, and hand-computed fixtures for the hazards of their definitions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rookery.features import content, identity, network, temporal
from rookery.features.common import finish, left_joined

T0 = dt.datetime(2024, 3, 4)  # a Monday
CAST = "id bigint, fid bigint, text string, timestamp timestamp_ntz, deleted_at timestamp_ntz, parent_url string, parent_hash binary, parent_fid bigint, root_parent_hash binary, embeds string, mentions string"


def some_casts(seed, n=300):
    rng = random.Random(seed)
    texts = [None, "", "gm", "price $5 https://a/b", "@bob CLAIM now", "a  b. c d.", "airdrop farm \U0001f680\U0001f680\U0001f680\U0001f680\U0001f680"]
    out = []
    for i in range(n):
        t = T0 + dt.timedelta(seconds=rng.randrange(90 * 86400))
        out.append((i, rng.choice([1, 1, 1, 1, 2, 3, 4]), rng.choice(texts), None if rng.random() < 0.03 else t, t if rng.random() < 0.1 else None, rng.choice([None, "c1", "c2"]), rng.choice([None, b"h"]), rng.choice([None, 1, 2]), None, rng.choice([None, "[]", '[{"url":"x.png"}]']), rng.choice([None, "[]", "[1,2]", "[1"])))
    return out


GROUPS = {
    "timing": temporal.timing,
    "patterns": temporal.patterns,
    "channels": temporal.channels,
    "trends": temporal.trends,
    "activity": lambda c: temporal.activity(c.select("fid", "id", "timestamp")),
    "rhythm": temporal.rhythm,
    "texts": content.texts,
    "mentions": content.mentions,
    "spam": content.spam,
    "style": content.style,
    "conversation": content.conversation,
    "replies": content.replies,
}


@pytest.mark.parametrize("name", GROUPS)
def test_order_and_batches_do_not_matter(spark, name):
    rows = some_casts(1)
    f = GROUPS[name]
    whole = {tuple(r) for r in f(spark.createDataFrame(rows, CAST)).collect()}
    random.Random(0).shuffle(rows)
    assert {tuple(r) for r in f(spark.createDataFrame(rows, CAST).repartition(5)).collect()} == whole
    parts = [[r for r in rows if r[1] == 1], [r for r in rows if r[1] != 1]]
    split = [tuple(r) for p in parts for r in f(spark.createDataFrame(p, CAST)).collect()]
    assert len(split) == len(set(split)) and set(split) == whole


@pytest.mark.parametrize("name", GROUPS)
def test_empty_tables_and_extra_columns(spark, name):
    df = spark.createDataFrame(some_casts(2, 20), CAST).withColumns({c: F.lit(1) for c in ("n", "h", "chunk", "gap", "hours", "l", "m", "i", "b", "x")})
    f = GROUPS[name]
    assert f(df.limit(0)).count() == 0 and f(df).count() > 0


def test_bounds(spark):
    t = temporal.timing(spark.createDataFrame(some_casts(3), CAST)).collect()
    for r in t:
        assert 0 <= r["activity_entropy"] <= math.log2(24) and abs(r["prime_time_ratio"] + r["off_hours_activity"] - 1) < 2e-6
        assert r["hour_diversity"] == r["rhythm_score"] == r["daily_active_hours"] <= 24


def test_weekdays_one_event_and_ties(spark):
    week = [(i, 1, None, T0 + dt.timedelta(days=i), None) for i in range(7)]
    same = [(i, 2, None, T0, None) for i in (7, 8, 9)]
    cols = "id bigint, fid bigint, text string, timestamp timestamp_ntz, deleted_at timestamp_ntz"
    df = spark.createDataFrame(week + same + [(10, 3, None, T0, None)], cols)
    t = {r["fid"]: r for r in temporal.timing(df).collect()}
    assert t[1]["weekend_activity_ratio"] == round(2 / 7, 6) and t[1]["weekday_diversity"] == 7
    assert temporal.timing(df.where("fid = 1"), weekend=(6, 7)).first()["weekend_activity_ratio"] == round(2 / 7, 6)
    assert t[2]["temporal_clustering"] == round(2 / 3, 6) and t[3]["temporal_consistency"] == 0 and t[3]["activity_entropy"] == 0


def test_thresholds_of_gaps(spark):
    gaps = [0, 59 * 60 + 59, 3600, 24 * 3600, 24 * 3600 + 59 * 60, 25 * 3600]
    at, rows = T0, []
    for i, g in enumerate(gaps):
        at += dt.timedelta(seconds=g)
        rows.append((i, 1, at))
    r = temporal.intervals(spark.createDataFrame(rows, "id bigint, fid bigint, timestamp timestamp_ntz"), "fid", "timestamp", "id", "x").first()
    assert (r["x_count"], r["sequential_x"], r["x_gaps"]) == (6, 1, 1)  # 24 h 59 min truncates to 24, not more than 24


def test_profiles(spark):
    p = [(1, "alice.eth", "b", "u", '["0x' + "a" * 40 + '"]', "Al"), (2, None, None, None, "[]", None), (3, "user12345", "", None, None, "x__y"), (3, "user12345", "", None, None, "x__y")]
    df = spark.createDataFrame(p, "fid bigint, fname string, bio string, avatar_url string, verified_addresses string, display_name string")
    r = {x["fid"]: x for x in identity.profile(df).collect()}
    assert r[1]["profile_completeness"] == 1.0 and r[1]["verification_count"] == 1 and r[1]["verification_count_exact"] == 1
    assert r[2]["profile_completeness"] == 0.0 and r[2]["verification_count"] == 0 and r[3]["fname_random_numbers"] == 1
    assert len(r) == 3


def test_degrees_of_one_sided_accounts(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (3, 3), (None, 1), (4, None)], "fid bigint, target_fid bigint")
    d = {r["fid"]: tuple(r)[1:] for r in network.degrees(e).collect()}
    assert d == {1: (2, 1, 0, 0), 2: (0, 0, 2, 1), 3: (1, 1, 1, 1)}
    assert network.centrality(e.limit(0)).count() == 0 and network.ratios(network.degrees(e.limit(0))).count() == 0


def test_counters_out_of_order_and_zero(spark):
    rows = [(1, 5, 1, T0 + dt.timedelta(days=2), 3), (1, 0, 2, T0, 1), (1, 3, None, T0 + dt.timedelta(days=1), 2), (2, 4, 4, T0, 1), (2, 4, 4, T0, 2)]
    df = spark.createDataFrame(rows, "fid bigint, follower_count bigint, following_count bigint, created_at timestamp_ntz, export_ts bigint")
    r = {x["fid"]: x for x in network.counters(df).collect()}
    assert (r[1]["follower_count"], r[1]["following_count"], r[1]["follower_growth_rate"]) == (5, 1, 0.0)  # from 0: no rate
    assert r[1]["following_growth_rate"] == -0.5 and r[2]["relationship_health"] == 1.0


def test_ownership_and_defaults(spark):
    a = spark.createDataFrame([(1, 1.0, None)], "fid bigint, x double, y bigint")
    b = spark.createDataFrame([(1, 9.0, 2), (2, 8.0, 3)], "fid bigint, x double, z bigint")
    j = finish(left_joined(a.select("fid"), [a, b]))
    assert j.columns == ["fid", "x", "y", "z"] and tuple(j.first()) == (1, 1.0, 0, 2)
