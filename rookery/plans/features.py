"""Feature queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.features import content, identity, network, reputation, temporal
from rookery.features.common import left_joined
from rookery.features.registry import FeatureContext, FeatureManager, FeatureRegistry, FeatureSet
from rookery.functions.text import address_list
from rookery.ml.labels import target_of
from rookery.plans.registry import Registry, rounded, whole
from rookery.sources import views as V
from rookery.sources.tables import activity, table

R = Registry()


def _gaps(src: str, where: str = "true", tie: str = "id", name: str = "g") -> str:
    """SQL of gaps between an account's successive rows."""
    lag = f"lag(timestamp) OVER (PARTITION BY fid ORDER BY timestamp, {tie})"
    return f"{name} AS (SELECT *, date_sub('second', {lag}, timestamp) AS gap_s, date_sub('minute', {lag}, timestamp) AS gap_m, date_sub('hour', {lag}, timestamp) AS gap_h FROM {src} WHERE fid IS NOT NULL AND timestamp IS NOT NULL AND {where})"


_Q = "list_sort(list(gap_h) FILTER (gap_h IS NOT NULL))[CAST(round((count(gap_h) - 1) * {q}::DOUBLE) AS INT) + 1]"


@R.add(
    V.with_views("c", "SELECT a.*, coalesce(round(e.h, 6), 0.0) AS activity_entropy, coalesce(round(e.sd, 6), 0.0) AS hour_count_std FROM a LEFT JOIN e USING (fid)", _gaps("c") + ", a AS (SELECT fid, "
    + whole(hour_diversity="count(DISTINCT hour(timestamp))", daily_active_hours="count(DISTINCT hour(timestamp))", rhythm_score="count(DISTINCT hour(timestamp))", weekday_diversity="count(DISTINCT isodow(timestamp))", inactive_periods="count(*) FILTER (gap_h > 24)", variability_index=f"{_Q.format(q=0.9)} - {_Q.format(q=0.1)}")
    + ", " + rounded(temporal_consistency="stddev_samp(gap_h)", prime_time_ratio="count(*) FILTER (hour(timestamp) BETWEEN 9 AND 22) / count(*)", off_hours_activity="1 - count(*) FILTER (hour(timestamp) BETWEEN 9 AND 22) / count(*)", weekend_activity_ratio="count(*) FILTER (isodow(timestamp) IN (5, 6)) / count(*)", global_reach="count(DISTINCT hour(timestamp)) / 24", temporal_clustering="count(*) FILTER (gap_h < 1) / count(*)")
    + " FROM g GROUP BY fid), e AS (SELECT fid, -sum(n / t * log2(n / t)) AS h, stddev_samp(n) AS sd FROM (SELECT fid, count(*) AS n, sum(count(*)) OVER (PARTITION BY fid) AS t FROM g GROUP BY fid, hour(timestamp)) GROUP BY fid)")
)
def temporal_timing(spark: SparkSession, d: str) -> DataFrame:
    return temporal.timing(V.casts(spark, d, ["fid", "timestamp"]))


_BURST = {"avg_follow_latency_seconds": "avg(gap_s)", "response_latency": "avg(gap_h)", "interaction_timing": "stddev_samp(gap_h)", "burst_duration": "avg(gap_m) FILTER (gap_m < 5)", "inter_burst_interval": "avg(gap_m) FILTER (gap_m >= 5)", "burst_intensity": "count(*) FILTER (gap_m < 5) / (count(*) FILTER (gap_m < 5) + 1)", "burst_engagement_ratio": "count(*) FILTER (gap_m < 5) / count(*)"}


@R.add(V.with_views("c", f"SELECT fid, {rounded(**_BURST)}, {whole(posting_frequency='count(*)', engagement_windows='count(*) FILTER (gap_h < 1)', burst_frequency='count(*) FILTER (gap_m < 5)', burst_impact='count(*) FILTER (gap_m < 5)')} FROM g GROUP BY fid", _gaps("c", "deleted_at IS NULL")))
def burst_metrics(spark: SparkSession, d: str) -> DataFrame:
    return temporal.patterns(V.casts(spark, d, ["fid", "timestamp", "deleted_at"]))


@R.add(V.with_views("c", f"SELECT fid, {whole(unique_channels='count(DISTINCT parent_url)')}, {rounded(cross_channel_activity='count(DISTINCT parent_url) / nullif(count(parent_url), 0)', multi_channel_ratio='count(parent_url) / count(*)')} FROM c WHERE deleted_at IS NULL GROUP BY fid"))
def channel_metrics(spark: SparkSession, d: str) -> DataFrame:
    return temporal.channels(V.casts(spark, d, ["fid", "parent_url", "deleted_at"]))


@R.add(V.with_views("c", f"SELECT fid, {rounded(trend_stability='avg(sd)', adaptation_rate='stddev_samp(mean - before)')} FROM (SELECT *, lag(mean) OVER (PARTITION BY fid ORDER BY timestamp, id) AS before FROM x) GROUP BY fid",
    _gaps("c") + ", x AS (SELECT fid, timestamp, id, stddev_samp(gap_h) OVER w AS sd, avg(gap_h) OVER w AS mean FROM g WINDOW w AS (PARTITION BY fid ORDER BY timestamp, id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"))
def rolling_24(spark: SparkSession, d: str) -> DataFrame:
    return temporal.trends(V.casts(spark, d, ["fid", "timestamp"]))


_EV = "ev AS (SELECT fid, row(1, id) AS id, timestamp FROM c WHERE timestamp IS NOT NULL UNION ALL SELECT fid, row(2, id), timestamp FROM r WHERE timestamp IS NOT NULL)"


def _activity(spark: SparkSession, d: str) -> DataFrame:
    e = activity(table(spark, d, "casts", ["id", "fid", "timestamp"]), table(spark, d, "reactions", ["id", "fid", "timestamp"])).distinct()
    return e.select("fid", F.struct("kind", "id").alias("id"), "timestamp")


_SPAN = "date_sub('hour', min(timestamp), max(timestamp))"


@R.add(V.with_views("c r", "SELECT fid, "
    + whole(total_activity="count(*)", rapid_actions="count(*) FILTER (gap_h < 1)", long_gaps="count(*) FILTER (gap_h > 24)", actions_in_bursts="count(*) FILTER (gap_m < 5)", time_span=_SPAN, rapid_action_count="count(*) FILTER (gap_s < 2)", has_robotic_timing="coalesce(stddev_samp(gap_s) < 1, false)::INT", p10_time_between_actions=_Q.format(q=0.1), p90_time_between_actions=_Q.format(q=0.9))
    + ", " + rounded(avg_hours_between_actions="avg(gap_h)", std_hours_between_actions="stddev_samp(gap_h)", weekday_variance="stddev_samp(isodow(timestamp))", avg_burst_interval="avg(gap_s) FILTER (gap_m < 5)", burst_activity_ratio="count(*) FILTER (gap_m < 5) / count(*)", activity_spread=f"{_SPAN} / count(*)", temporal_irregularity="stddev_samp(gap_h) / (avg(gap_h) + 1)", follow_velocity=f"count(*) / ({_SPAN} + 1)")
    + " FROM g GROUP BY fid", _EV + ", " + _gaps("ev")))
def activity_union(spark: SparkSession, d: str) -> DataFrame:
    return temporal.activity(_activity(spark, d))


@R.add(V.with_views("c r", f"SELECT fid, h.total_activities, {rounded(hour_std='h.sd', weekday_std='w.sd')} FROM h JOIN w USING (fid)", _EV
    + ", h AS (SELECT fid, stddev_samp(n) AS sd, sum(n)::BIGINT AS total_activities FROM (SELECT fid, count(*) AS n FROM ev GROUP BY fid, hour(timestamp)) GROUP BY fid), w AS (SELECT fid, stddev_samp(n) AS sd FROM (SELECT fid, count(*) AS n FROM ev GROUP BY fid, isodow(timestamp)) GROUP BY fid)"))
def value_count_std(spark: SparkSession, d: str) -> DataFrame:
    return temporal.rhythm(_activity(spark, d))


def _intervals_sql(view: str, tie: str, name: str, where: str = "true") -> str:
    return V.with_views(view, f"SELECT fid, {whole(**{f'{name}_count': 'count(*)', f'sequential_{name}': 'count(*) FILTER (gap_h < 1)', f'{name}_gaps': 'count(*) FILTER (gap_h > 24)'})}, {rounded(**{f'avg_hours_between_{name}': 'avg(gap_h)', f'std_hours_between_{name}': 'stddev_samp(gap_h)', f'{name}_consistency': 'stddev_samp(gap_h) / (avg(gap_h) + 1)'})} FROM g GROUP BY fid", _gaps(view, where, tie))


@R.add(_intervals_sql("sg", "deleted_at", "signers"))
def signer_intervals(spark: SparkSession, d: str) -> DataFrame:
    return temporal.intervals(V.signers(spark, d), "fid", "timestamp", "deleted_at", "signers")


@R.add(_intervals_sql("v", "id", "updates", "deleted_at IS NULL"))
def update_behavior(spark: SparkSession, d: str) -> DataFrame:
    return temporal.intervals(V.verifications(spark, d).where("deleted_at IS NULL"), "fid", "timestamp", "id", "updates")


# fixed values: the same patterns in the dialect of the SQL engine
_RE = {"random_numbers": "[0-9]{4,}", "wallet_pattern": "0x[a-fA-F0-9]{40}", "excessive_symbols": r"[_.\-]{2,}", "airdrop_terms": r"(?i)\b(airdrop|farm|degen|wojak)\b", "has_year": r"\b(19|20)[0-9]{2}\b"}
_DIV = r"len(list_distinct(list_filter(string_split(lower(regexp_replace({c}, '[^a-zA-Z0-9]', '', 'g')), ''), lambda c: c <> ''))) / (length({c}) + 1)"
_HAS = {"has_ens": r"regexp_matches(fname, '\.eth$')", "has_bio": "bio IS NOT NULL", "has_avatar": "avatar_url IS NOT NULL", "has_display_name": "display_name IS NOT NULL"}
_ADDR = "CASE WHEN json_valid(verified_addresses) THEN len(list_distinct(list_filter(CAST(json_extract_string(verified_addresses, '$[*]') AS VARCHAR[]), lambda a: starts_with(a, '0x') AND length(a) = 42))) ELSE 0 END"


def _profile_sql() -> str:
    flags = {f"{c}_{p}": f"max(regexp_matches({c}, '{_RE[p]}')::INT)" for c in ("fname", "bio") for p in _RE}
    return V.with_views("p", "SELECT fid, "
        + whole(**{k: f"max(({v})::INT)" for k, v in _HAS.items()}, display_name_length="max(length(display_name))", bio_length="max(length(bio))", **flags, verification_count="max(CASE WHEN verified_addresses LIKE '%,%' THEN 2 WHEN verified_addresses <> '[]' THEN 1 ELSE 0 END)", verification_count_exact=f"max({_ADDR})")
        + ", " + rounded(fname_entropy=f"max({_DIV.format(c='fname')})", bio_entropy=f"max({_DIV.format(c='bio')})", profile_completeness="max((" + " + ".join(f"({v})::INT" for v in _HAS.values()) + ") / 4)") + " FROM p GROUP BY fid")


@R.add(_profile_sql())
def profile_completeness(spark: SparkSession, d: str) -> DataFrame:
    return identity.profile(V.profiles(spark, d))


@R.add("WITH x AS (" + _profile_sql() + ") SELECT fid, round(1 - 0.2 * (fname_random_numbers + fname_wallet_pattern + fname_airdrop_terms + bio_airdrop_terms + bio_wallet_pattern)::DOUBLE, 6) AS profile_authenticity FROM x")
def authenticity_score(spark: SparkSession, d: str) -> DataFrame:
    return identity.profile_authenticity(identity.profile(V.profiles(spark, d)))


_VERIFY = V.with_views("v", "SELECT fid, "
    + whole(total_verifications="count(*)", eth_verifications="count(*) FILTER (contains(claim, 'ethSignature'))", sequential_verifications="count(*) FILTER (gap_h < 1)", verification_gaps="count(*) FILTER (gap_h > 24)", platforms_verified="count(DISTINCT platform)", platform_diversity="count(DISTINCT platform)", verification_velocity="count(platform)", claim_kinds="count(DISTINCT claim)", verification_span_days="date_sub('day', min(timestamp), max(timestamp))")
    + ", " + rounded(avg_hours_between_verifications="avg(gap_h)", verification_timing_std="stddev_samp(gap_h)", verification_consistency="stddev_samp(gap_h) / (avg(gap_h) + 1)") + " FROM g GROUP BY fid", _gaps("v", "deleted_at IS NULL"))


@R.add(_VERIFY)
def verification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return identity.verification(V.verifications(spark, d))


_C, _P = "total_verifications::DOUBLE", "claim_kinds::DOUBLE"


@R.add(f"WITH z AS ({_VERIFY}) SELECT fid, " + rounded(verification_strength=f"{_C} * {_P}", identity_confidence=f"{_P} / 10", spam_resistance=f"1 - 1 / ({_C} + 1)", abuse_likelihood=f"greatest(least(1 - {_P} / {_C}, 1), 0)", credibility_score=f"{_P} / {_C}", reliability_index=f"greatest(least({_C} * {_P} / 100, 1), 0)") + " FROM z")
def trust_metrics(spark: SparkSession, d: str) -> DataFrame:
    return identity.trust(identity.verification(V.verifications(spark, d)))


_GROWTH = "arg_max(units, row(timestamp, id)) - arg_min(units, row(timestamp, id))"
_STORE = V.with_views("st", "SELECT fid, "
    + rounded(storage_units="a", storage_utilization="m", storage_growth="g", storage_stability="sd", storage_efficiency="a / nullif(m, 0)", storage_growth_rate="g / n", resource_utilization="0.5 * a / nullif(m, 0) + 0.3 * coalesce(sd, 0) + 0.2 * (1 - greatest(least(g / n, 1), 0))")
    + ", " + whole(storage_update_frequency="n") + " FROM x", f"x AS (SELECT fid, avg(units) AS a, max(units) AS m, {_GROWTH} AS g, stddev_samp(units) AS sd, count(*) AS n FROM st WHERE deleted_at IS NULL GROUP BY fid)")


@R.add(_STORE)
def storage_metrics(spark: SparkSession, d: str) -> DataFrame:
    return identity.storage(V.storage(spark, d))


@R.add(f"WITH p1 AS ({_profile_sql()}), v1 AS ({_VERIFY}) SELECT fid, "
    + rounded(identity_strength="0.4 * profile_completeness + 0.3 * coalesce(verification_consistency, 0) + 0.3 * coalesce(platforms_verified, 0) / 5", verification_quality="0.4 * coalesce(platform_diversity, 0) + 0.3 * coalesce(verification_consistency, 0) + 0.3 * coalesce(eth_verifications / total_verifications, 0)")
    + " FROM p1 LEFT JOIN v1 USING (fid)")
def identity_derived(spark: SparkSession, d: str) -> DataFrame:
    return identity.identity_scores(identity.profile(V.profiles(spark, d)), identity.verification(V.verifications(spark, d)))


@R.add(V.with_views("f", "SELECT k.fid, "
    + whole(following_count="a.n", unique_following="a.u", total_follows="k.n", stable_connections="k.stable", network_age_hours="a.age", network_centrality="a.n + a.u", network_reach="a.u", network_diversity="a.u")
    + ", " + rounded(follow_ratio="a.n / (a.u + 1)", follow_velocity="a.n / nullif(a.mean_gap, 0)", follow_rate_per_hour="k.n / (a.age + 1)", growth_stability="a.sd", avg_follow_latency_seconds="a.latency", network_density="a.u / nullif(a.n, 0)", community_embedding="a.u / nullif(a.n, 0)", network_volatility="a.sd", network_churn_rate="k.gone / k.n", follower_retention="1 - k.gone / k.n")
    + " FROM k LEFT JOIN a USING (fid)", _gaps("f", "deleted_at IS NULL", "target_fid")
    + ", a AS (SELECT fid, count(target_fid) AS n, count(DISTINCT target_fid) AS u, date_sub('hour', min(timestamp), max(timestamp)) AS age, avg(gap_h) AS mean_gap, stddev_samp(gap_h) AS sd, avg(date_sub('second', timestamp, created_at)) AS latency FROM g GROUP BY fid)"
    + ", k AS (SELECT fid, count(*) AS n, count(deleted_at) AS gone, count(*) FILTER (date_sub('day', created_at, coalesce(deleted_at, timestamp)) > 30) AS stable FROM f GROUP BY fid)"))
def network_basic(spark: SparkSession, d: str) -> DataFrame:
    return network.following(V.follows(spark, d))


@R.add("WITH n AS (" + R.oracle["network_basic"] + ") SELECT fid, " + rounded(follow_velocity_log="ln(1 + follow_velocity)", follow_velocity_capped="greatest(least(follow_velocity, (SELECT quantile_cont(follow_velocity, 0.99) FROM n)), 0)") + " FROM n")
def follow_velocity(spark: SparkSession, d: str) -> DataFrame:
    return network.velocity(network_basic(spark, d))


@R.add(V.with_views("c", "SELECT fid, count(DISTINCT parent_url) + max((parent_url IS NULL)::INT) AS target_url_diversity FROM c WHERE deleted_at IS NULL GROUP BY fid"))
def link_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Posts into channels stand in for reactions to URLs."""
    return network.link_diversity(V.casts(spark, d, ["fid", "parent_url", "deleted_at"]).withColumnRenamed("parent_url", "target_url"))


_DEG = "dg AS (SELECT fid, coalesce(o.n, 0) AS out_degree, coalesce(o.u, 0) AS unique_out_degree, coalesce(i.n, 0) AS in_degree, coalesce(i.u, 0) AS unique_in_degree FROM (SELECT fid, count(*) AS n, count(DISTINCT target_fid) AS u FROM lf GROUP BY 1) o FULL JOIN (SELECT target_fid AS fid, count(*) AS n, count(DISTINCT fid) AS u FROM lf GROUP BY 1) i USING (fid))"
_LF = "lf AS (SELECT * FROM f WHERE deleted_at IS NULL)"


def _live(spark: SparkSession, d: str) -> DataFrame:
    return V.follows(spark, d).where("deleted_at IS NULL")


@R.add(V.with_views("f", "SELECT fid, out_degree, unique_out_degree, in_degree, unique_in_degree, " + rounded(centrality_score="(out_degree + in_degree) / (SELECT max(out_degree) + max(in_degree) FROM dg)", bridge_score="unique_out_degree * unique_in_degree / (out_degree + in_degree + 1)", clustering_coefficient="unique_out_degree * unique_in_degree / ((out_degree + 1) * (in_degree + 1))") + " FROM dg", _LF + ", " + _DEG))
def network_centrality(spark: SparkSession, d: str) -> DataFrame:
    return network.centrality(_live(spark, d))


@R.add(V.with_views("f", "SELECT fid, follower_ratio_log, unique_follower_ratio_log, follower_ratio, follower_ratio_capped, unique_follower_ratio_capped, has_more_followers, follow_balance_ratio, follow_balance_ratio AS follower_authenticity_score FROM (SELECT fid, "
    + rounded(follower_ratio="fr", follower_ratio_log="ln(1 + fr)", unique_follower_ratio_log="ln(1 + ur)", follower_ratio_capped="greatest(least(fr, (SELECT quantile_cont(fr, 0.99) FROM x)), 0)", unique_follower_ratio_capped="greatest(least(ur, (SELECT quantile_cont(ur, 0.99) FROM x)), 0)", follow_balance_ratio="1 - abs(out_degree - in_degree) / (out_degree + in_degree + 1)")
    + ", " + whole(has_more_followers="(in_degree > out_degree)::INT") + " FROM x)", _LF + ", " + _DEG + ", x AS (SELECT *, in_degree / (out_degree + 1) AS fr, unique_in_degree / (unique_out_degree + 1) AS ur FROM dg)"))
def p99_cap(spark: SparkSession, d: str) -> DataFrame:
    return network.ratios(network.degrees(_live(spark, d)))


@R.add(V.with_views("f", "SELECT a.fid, count(b.fid) AS reciprocal_count, round(count(b.fid) / count(*), 6) AS follow_reciprocity FROM e a LEFT JOIN e b ON a.fid = b.target_fid AND a.target_fid = b.fid GROUP BY a.fid", "e AS (SELECT DISTINCT fid, target_fid FROM f WHERE deleted_at IS NULL AND fid <> target_fid)"))
def network_reciprocity(spark: SparkSession, d: str) -> DataFrame:
    return network.reciprocity(_live(spark, d))


_O = "row(created_at, export_ts)"
_LASTF, _LASTG = f"arg_max(follower_count, {_O}) FILTER (follower_count IS NOT NULL)", f"arg_max(following_count, {_O}) FILTER (following_count IS NOT NULL)"


@R.add(V.with_views("fc", "SELECT fid, " + whole(follower_count="f", following_count="g") + ", "
    + rounded(follower_growth_rate="(f - f0) / nullif(f0, 0)", growth_trajectory="(f - f0) / nullif(f0, 0)", network_quality="f / (g + 1)", following_growth_rate="(g - g0) / nullif(g0, 0)", network_growth_rate="sf + sg", influence_score="f / (g + 1)", activity_score="f / nullif(f0, 0)", counter_centrality="(f + g) / nullif(fm, 0)", relationship_health="1 - abs(f - g) / (f + g + 1)", sustainability_index="1 - sf / nullif(mf, 0)")
    + " FROM a", "s AS (SELECT *, follower_count - lag(follower_count) OVER w AS df, following_count - lag(following_count) OVER w AS dg FROM fc WINDOW w AS (PARTITION BY fid ORDER BY created_at NULLS FIRST, export_ts NULLS FIRST, follower_count NULLS FIRST, following_count NULLS FIRST))"
    + f", a AS (SELECT fid, {_LASTF} AS f, {_LASTG} AS g, {_LASTF.replace('arg_max', 'arg_min')} AS f0, {_LASTG.replace('arg_max', 'arg_min')} AS g0, max(follower_count) AS fm, stddev_samp(df) AS sf, stddev_samp(dg) AS sg, avg(df) AS mf FROM s GROUP BY fid)"))
def first_last_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return network.counters(V.follow_counts(spark, d))


@R.add(V.with_views("bl", "SELECT blocker_fid AS fid, count(*) AS blocks_made, count(DISTINCT blocked_fid) AS unique_blocks, round(count(*) / (count(DISTINCT blocked_fid) + 1), 6) AS block_repeat_ratio FROM bl WHERE blocker_fid IS NOT NULL GROUP BY 1"))
def blocking_behavior(spark: SparkSession, d: str) -> DataFrame:
    return network.blocking(V.blocks(spark, d))


@R.add(V.with_views("f fc", "SELECT fid, " + rounded(influential_followers="avg(score)", influencer_ratio="count(*) FILTER (score > m) / count(*)") + " FROM (SELECT e.fid, score, avg(score) OVER (PARTITION BY e.fid) AS m FROM e JOIN s ON e.target_fid = s.fid) GROUP BY fid",
    "e AS (SELECT DISTINCT fid, target_fid FROM f WHERE deleted_at IS NULL), s AS (SELECT fid, max(follower_count) AS score FROM fc GROUP BY fid HAVING max(follower_count) IS NOT NULL)"))
def influence_of_targets(spark: SparkSession, d: str) -> DataFrame:
    scores = V.follow_counts(spark, d).groupBy("fid").agg(F.max("follower_count").alias("score")).where("score IS NOT NULL")
    return network.influence_of_targets(_live(spark, d), scores)


_SPLIT = "string_split(text, ' ')"


@R.add(V.with_views("c", "SELECT fid, " + whole(cast_count="count(text)", reply_count="count(*) FILTER (parent_hash IS NOT NULL AND text IS NOT NULL)", mention_count="count(*) FILTER (regexp_matches(text, '@[A-Za-z0-9_]+'))") + ", "
    + rounded(avg_cast_length="avg(length(text))", link_usage_rate="sum(len(regexp_extract_all(text, 'https?://'))) / nullif(count(text), 0)", content_type_diversity=f"avg(len(list_distinct({_SPLIT})) / (len({_SPLIT}) + 1))", content_complexity=f"avg(list_sum(list_transform({_SPLIT}, lambda x: length(x))) / len({_SPLIT}) * len(string_split(text, '.')))", vocabulary_richness=f"avg(coalesce(len(list_distinct({_SPLIT})), 0))", hashtag_usage="avg(len(regexp_extract_all(text, 'https?://')))",
        content_originality="(count(DISTINCT text) + max((text IS NULL)::INT)) / nullif(count(text), 0)", content_uniqueness="(count(DISTINCT text) + max((text IS NULL)::INT)) / count(*)")
    + " FROM c WHERE deleted_at IS NULL GROUP BY fid"))
def content_metrics(spark: SparkSession, d: str) -> DataFrame:
    return content.texts(V.casts(spark, d, ["fid", "text", "parent_hash", "deleted_at"]))


_JL = "CASE WHEN json_valid(mentions) THEN coalesce(json_array_length(mentions)::BIGINT, 0) ELSE 0 END"
_FLAG = lambda p: f"avg(coalesce(regexp_matches(text, '{p}'), false)::INT)"


@R.add(V.with_views("c", "SELECT fid, " + whole(total_mentions=f"sum({_JL})", casts_with_mentions=f"count(*) FILTER ({_JL} > 0)") + ", "
    + rounded(avg_mentions_per_cast=f"avg({_JL})", emoji_spam_ratio=_FLAG(r"[\x{1F300}-\x{1F9FF}]{5,}"), price_mention_ratio=_FLAG(r"\$[0-9]+|[0-9]+\$"), symbol_spam_ratio=_FLAG(_RE["excessive_symbols"]), airdrop_term_ratio=_FLAG(_RE["airdrop_terms"]), mention_frequency=f"count(*) FILTER ({_JL} > 0) / count(*)") + " FROM c WHERE deleted_at IS NULL AND text IS NOT NULL GROUP BY fid"))
def mention_metrics(spark: SparkSession, d: str) -> DataFrame:
    return content.mentions(V.casts(spark, d, ["fid", "text", "mentions", "deleted_at"]))


_WW = lambda t: r"\b(" + "|".join(t) + r")\b"
_CNT = lambda p: "sum(coalesce(len(regexp_extract_all(text, '" + p.replace("'", "''") + "')), 0))"


@R.add(V.with_views("c", "SELECT fid, " + rounded(spam_keyword_ratio="s / n", promotional_ratio="p / n", suspicious_pattern_ratio="x / n", rapid_post_ratio="rapid / n", spam_score="(s + 2 * p + 1.5 * x) / n") + " FROM a", _gaps("c", "deleted_at IS NULL")
    + f", a AS (SELECT fid, count(*) AS n, {_CNT(_WW(content.SPAM_WORDS))} AS s, {_CNT(_WW(content.PROMOTION))} AS p, {_CNT('[!$@#%]{2,}|[0-9]{10,}|[A-Z]{5,}')} AS x, count(*) FILTER (gap_s < 60) AS rapid FROM g GROUP BY fid)"))
def spam_metrics(spark: SparkSession, d: str) -> DataFrame:
    return content.spam(V.casts(spark, d, ["fid", "text", "timestamp", "deleted_at"]))


_LOW = lambda p: f"avg(coalesce(regexp_matches(low, '{p}'), false)::INT)"
_TIMES = lambda p: f"coalesce(len(regexp_extract_all(low, '{p}')), 0)"


@R.add(V.with_views("c", "SELECT fid, " + whole(total_links="sum(l)", casts_with_links="count(*) FILTER (l > 0)", total_media="sum(m)", casts_with_media="count(*) FILTER (m > 0)", casts_with_both="count(*) FILTER (l > 0 AND m > 0)", **{f"lure_{w}": f"sum({_TIMES(w)})" for w in content.LURES}) + ", "
    + rounded(avg_at_symbol_ratio="avg((length(text) - length(replace(text, '@', ''))) / nullif(length(text), 0))", avg_dollar_symbol_ratio="avg((length(text) - length(replace(text, '$', ''))) / nullif(length(text), 0))", airdrop_mention_ratio=_LOW("|".join(content.AIRDROP)), template_usage_ratio=_LOW(content.TEMPLATE), cta_heavy_ratio=f"avg(({_TIMES('|'.join(content.CALLS))} > 2)::INT)", urgency_ratio=_LOW("|".join(content.URGENCY)), emoji_heavy_ratio=f"avg(({_TIMES(content.EMOJI)} > 5)::INT)", multimedia_ratio="count(*) FILTER (l > 0 AND m > 0) / count(*)", link_usage_rate="count(*) FILTER (l > 0) / count(*)", media_usage_rate="count(*) FILTER (m > 0) / count(*)", avg_links_per_link_cast="sum(l) / nullif(count(*) FILTER (l > 0), 0)", avg_media_per_media_cast="sum(m) / nullif(count(*) FILTER (m > 0), 0)")
    + " FROM x GROUP BY fid", "x AS (SELECT fid, text, lower(text) AS low, coalesce(contains(lower(text), 'http://'), false)::INT + coalesce(contains(lower(text), 'https://'), false)::INT + coalesce(contains(lower(text), 'www.'), false)::INT AS l, coalesce(len(regexp_extract_all(lower(embeds), 'image')), 0) AS m FROM c WHERE deleted_at IS NULL)"))
def cast_style(spark: SparkSession, d: str) -> DataFrame:
    return content.style(V.casts(spark, d, ["fid", "text", "embeds", "deleted_at"]))


@R.add(V.with_views("c", "SELECT fid, " + whole(parent_fid_diversity="count(DISTINCT parent_fid)") + ", " + rounded(conversation_initiation_rate="avg((parent_hash IS NULL)::INT)", conversation_depth="avg(depth)", thread_participation="avg((text IS NOT NULL)::INT)", root_thread_participation="avg((root_parent_hash IS NOT NULL)::INT)", embed_usage_ratio="avg((embeds IS NOT NULL)::INT)")
    + " FROM (SELECT *, count(parent_hash) OVER (PARTITION BY fid ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS depth FROM c WHERE deleted_at IS NULL AND timestamp IS NOT NULL) GROUP BY fid"))
def conversation_metrics(spark: SparkSession, d: str) -> DataFrame:
    return content.conversation(V.casts(spark, d, ["fid", "text", "timestamp", "deleted_at", "parent_hash", "parent_fid", "root_parent_hash", "embeds"]))


@R.add(V.with_views("c", "SELECT fid, " + whole(total_replies="count(*)", unique_users_replied_to="count(DISTINCT parent_fid)") + ", " + rounded(avg_seconds_between_replies="avg(gap_s)", std_seconds_between_replies="stddev_samp(gap_s)", reply_diversity="count(DISTINCT parent_fid) / (count(*) + 1)", reply_timing_variability="stddev_samp(gap_s) / (avg(gap_s) + 1)") + " FROM g GROUP BY fid", _gaps("c", "deleted_at IS NULL AND parent_fid IS NOT NULL")))
def reply_patterns(spark: SparkSession, d: str) -> DataFrame:
    return content.replies(V.casts(spark, d, ["fid", "timestamp", "deleted_at", "parent_fid"]))


_L, _RC = "count(*) FILTER (reaction_type = 1)", "count(*) FILTER (reaction_type = 2)"


@R.add(V.with_views("r", "SELECT fid, " + whole(total_reactions="count(*)", like_count=_L, recast_count=_RC, unique_users_reacted_to="count(DISTINCT target_fid)") + ", " + rounded(avg_hours_between_reactions="avg(gap_h)", std_hours_between_reactions="stddev_samp(gap_h)", like_ratio=f"{_L} / count(*)", recast_ratio=f"{_RC} / count(*)", reaction_diversity="count(DISTINCT target_fid) / (count(*) + 1)", likes_to_recasts_ratio=f"{_L} / ({_RC} + 1)", viral_coefficient=f"{_RC} / (count(*) + 1)") + " FROM g GROUP BY fid", _gaps("r", "deleted_at IS NULL")))
def reaction_patterns(spark: SparkSession, d: str) -> DataFrame:
    return content.reactions(V.reactions(spark, d))


_H = f"h AS (SELECT fid, {_LASTF} AS f, {_LASTG} AS g FROM fc GROUP BY fid)"
_LIVE_R = "lr AS (SELECT fid, count(*) AS n, count(DISTINCT target_fid) AS u FROM r WHERE deleted_at IS NULL GROUP BY 1)"


@R.add(V.with_views("c r fc", "SELECT fid, " + whole(reach_metrics="ru") + ", " + rounded(engagement_rate="rn / (fo + 1)", audience_reach="ru / (fo + 1)", engagement_consistency="CASE WHEN reacted THEN (SELECT stddev_samp(n) / (avg(n) + 1) FROM lr) END", engagement_impact="rn / nullif(cn, 0)", influence_score="(0.4 * fo + 0.3 * rn + 0.3 * cn) / (g + 1)", engagement_score="(cn + rn + mn) / 3", creation_consumption_ratio="cn / (rn + 1)", interaction_diversity="ru / (rn + 1)")
    + " FROM (SELECT fid, b.n IS NOT NULL AS reacted, coalesce(a.n, 0) AS cn, coalesce(b.n, 0) AS rn, coalesce(b.u, 0) AS ru, coalesce(h.f, 0) AS fo, coalesce(h.g, 0) AS g, coalesce(m.n, 0) AS mn FROM (SELECT fid, count(*) AS n FROM c WHERE deleted_at IS NULL GROUP BY 1) a FULL JOIN lr b USING (fid) LEFT JOIN h USING (fid) LEFT JOIN (SELECT fid, count(*) AS n FROM c WHERE deleted_at IS NULL AND parent_url IS NOT NULL AND parent_hash IS NULL GROUP BY 1) m USING (fid))",
    _H + ", " + _LIVE_R))
def engagement_metrics(spark: SparkSession, d: str) -> DataFrame:
    return content.engagement(V.casts(spark, d, ["fid", "deleted_at"]), V.reactions(spark, d), V.follow_counts(spark, d), V.memberships(spark, d))


@R.add(V.with_views("c r fc", "SELECT fid, " + whole(reactions_received="n", unique_reactors="u") + ", " + rounded(content_virality="v", influence_per_cast="u / k", weighted_engagement_quality="q", content_sustainability="s", audience_retention="w", content_effectiveness="0.3 * v + 0.3 * q + 0.2 * s + 0.2 * coalesce(w, 0)")
    + " FROM (SELECT *, n / k AS v, CASE WHEN u > 0 THEN n * u / (k * u) END AS q, CASE WHEN k > 1 THEN 1.0::DOUBLE END AS s, u / (f + 1) AS w FROM (SELECT a.fid, a.n AS k, coalesce(g.n, 0)::BIGINT AS n, coalesce(g.u, 0)::BIGINT AS u, h.f FROM (SELECT fid, count(*) AS n FROM c WHERE deleted_at IS NULL GROUP BY 1) a LEFT JOIN (SELECT target_fid AS fid, count(*) AS n, count(DISTINCT fid) AS u FROM r WHERE deleted_at IS NULL AND target_fid IS NOT NULL GROUP BY 1) g USING (fid) LEFT JOIN h USING (fid)))", _H))
def reactions_received(spark: SparkSession, d: str) -> DataFrame:
    return content.received(V.reactions(spark, d), V.casts(spark, d, ["fid", "deleted_at"]), V.follow_counts(spark, d))


_POWER = "pw AS (SELECT fid FROM fc GROUP BY fid HAVING max(follower_count) >= 100)"
_PC = "SELECT fid, count(*) AS n FROM {t} GROUP BY fid"


@R.add(V.with_views("c r fc", "SELECT fid, coalesce(a.n, 0) AS power_user_replies, coalesce(b.n, 0) AS power_user_mentions, coalesce(e.n, 0) AS power_user_reactions, " + rounded(power_user_interaction_ratio="(coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(e.n, 0)) / (coalesce(t.c, 0) + coalesce(t.r, 0) + 1)")
    + " FROM (SELECT fid, x.n AS c, y.n AS r FROM (SELECT fid, count(*) AS n FROM lc GROUP BY 1) x FULL JOIN (SELECT fid, count(*) AS n FROM lr GROUP BY 1) y USING (fid)) t LEFT JOIN (SELECT fid, count(*) AS n FROM lc WHERE parent_fid IN (SELECT fid FROM pw) GROUP BY 1) a USING (fid)"
    + " LEFT JOIN (SELECT fid, count(DISTINCT id) AS n FROM (SELECT fid, id, unnest(CASE WHEN json_valid(mentions) THEN CAST(json_extract_string(mentions, '$[*]') AS VARCHAR[]) ELSE [] END) AS m FROM lc) WHERE try_cast(m AS BIGINT) IN (SELECT fid FROM pw) GROUP BY 1) b USING (fid)"
    + " LEFT JOIN (SELECT fid, count(*) AS n FROM lr WHERE target_fid IN (SELECT fid FROM pw) GROUP BY 1) e USING (fid)", _POWER + ", lc AS (SELECT * FROM c WHERE deleted_at IS NULL), lr AS (SELECT * FROM r WHERE deleted_at IS NULL)"))
def power_user_interaction(spark: SparkSession, d: str) -> DataFrame:
    power = V.follow_counts(spark, d).groupBy("fid").agg(F.max("follower_count").alias("m")).where("m >= 100").select("fid")
    return content.power_interactions(V.casts(spark, d, ["fid", "deleted_at", "parent_fid", "mentions"]), V.reactions(spark, d), power)


_ACT = "ac AS (SELECT user_id AS fid, event_id AS id, event_type AS activity_type, ts AS timestamp, value AS impact_score, avg(value) OVER (PARTITION BY user_id) AS mean FROM events)"


@R.add("WITH " + _ACT + ", " + _gaps("ac") + ", k AS (SELECT fid, count(*) AS kinds, sum(k) AS typed, stddev_samp(k) AS k_sd, avg(k) AS k_mean, count(*) FILTER (k = 1) AS rare, sum(k * k) / sum(k) AS krm, sum(k * v) AS kv FROM (SELECT fid, activity_type, count(*) AS k, sum(impact_score) AS v FROM ac GROUP BY ALL) GROUP BY fid) SELECT a.* EXCLUDE (m), "
    + rounded(adaptability_score="kinds / typed", communication_style="k_sd / nullif(k_mean, 0)", innovation_index="rare / kinds", potential_score="m * krm", contribution_score="kv / typed")
    + " FROM (SELECT fid, max(mean) AS m, " + rounded(peer_reputation="max(mean)", participation_quality="max(mean)", authority_score="count(*) FILTER (impact_score > mean) / count(*)", community_standing="stddev_samp(impact_score) / nullif(max(mean), 0)", activity_authenticity="stddev_samp(impact_score) / nullif(max(mean), 0)", behavior_consistency="stddev_samp(gap_h) / nullif(avg(gap_h), 0)", pattern_reliability="stddev_samp(gap_h) FILTER (impact_score > mean)", response_quality="avg(impact_score) FILTER (activity_type = 'click')", collaboration_score="avg(impact_score) FILTER (activity_type IN ('click', 'view'))", value_generation="avg(impact_score) FILTER (impact_score > mean)", resilience_metric="1 - count(*) FILTER (impact_score < 0) / count(*)") + " FROM g GROUP BY fid) a JOIN k USING (fid)")
def activity_reputation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("fid"), F.col("event_id").alias("id"), F.col("event_type").alias("activity_type"), F.col("ts").alias("timestamp"), F.col("value").alias("impact_score"))
    return reputation.activity_reputation(e, responses=["click"], collaboration=["click", "view"])


@R.add("SELECT fid, " + rounded(engagement_quality="avg(q)", content_impact="avg(r * q)", interaction_value="avg(q / nullif(r, 0))") + " FROM (SELECT l_suppkey AS fid, l_discount AS r, l_quantity AS q FROM lineitem) GROUP BY fid")
def rated_engagement(spark: SparkSession, d: str) -> DataFrame:
    return reputation.rated_engagement(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("fid"), F.col("l_discount").alias("engagement_rate"), F.col("l_quantity").alias("quality_score")))


_SC = "sc AS (SELECT fid, coalesce(follower_count, 0)::DOUBLE AS score, row(created_at, export_ts) AS o FROM fc)"
_HIST = "SELECT fid, " + rounded(last_score="arg_max(score, o)", avg_score="avg(score)", score_std="stddev_samp(score)", score_range="max(score) - min(score)", score_trend="arg_max(score, o) - arg_min(score, o)", relative_trend="(arg_max(score, o) - arg_min(score, o)) / nullif(arg_min(score, o), 0)") + " FROM sc GROUP BY fid"


def _history(spark: SparkSession, d: str) -> DataFrame:
    h = V.follow_counts(spark, d).groupBy("fid", "created_at", "export_ts").agg(F.max("follower_count").alias("score"))
    return reputation.score_history(h, ("created_at", "export_ts"))


@R.add(V.with_views("fc", _HIST, _SC))
def score_history(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d)


_AUTH = f"""pr AS ({_profile_sql()}), cn AS (SELECT fid, {whole(follower_count=_LASTF, following_count=_LASTG)} FROM fc GROUP BY fid), up AS ({_intervals_sql("v", "id", "updates", "deleted_at IS NULL")}),
au AS (SELECT fid, (has_bio + has_avatar + has_ens + (verification_count > 0)::INT) / 4 AS w, CASE WHEN coalesce(f, 0) + coalesce(g, 0) > 0 THEN 1 - abs(coalesce(f, 0) - coalesce(g, 0)) / (coalesce(f, 0) + coalesce(g, 0)) ELSE 0 END AS b, CASE WHEN coalesce(u, 0) > 0 THEN 1 - least(greatest(c, 0), 1) ELSE 0 END AS n
  FROM (SELECT pr.*, cn.follower_count AS f, cn.following_count AS g, up.updates_count AS u, up.updates_consistency AS c FROM pr LEFT JOIN cn USING (fid) LEFT JOIN up USING (fid)))"""
_AUTH_SELECT = "SELECT fid, " + rounded(network_balance="b", update_naturalness="n", authenticity_score="0.4 * w + 0.3 * b + 0.3 * n") + " FROM au"


def _authentic(spark: SparkSession, d: str) -> DataFrame:
    return reputation.authenticity(identity.profile(V.profiles(spark, d)), network.counters(V.follow_counts(spark, d)), update_behavior(spark, d))


@R.add(V.with_views("fc", _AUTH_SELECT, _AUTH))
def account_authenticity(spark: SparkSession, d: str) -> DataFrame:
    return _authentic(spark, d)


@R.add(V.with_views("fc", "SELECT fid, " + rounded(score_divergence="abs(last_score - authenticity_score)", relative_score_diff="(last_score - authenticity_score) / (authenticity_score + 1e-6)") + f" FROM ({_HIST}) JOIN ({_AUTH_SELECT}) USING (fid)", _SC + ", " + _AUTH))
def score_divergence(spark: SparkSession, d: str) -> DataFrame:
    return reputation.score_divergence(_history(spark, d), _authentic(spark, d))


@R.add("SELECT fid, coalesce(max((avatar_url IS NOT NULL)::INT) + max((bio IS NOT NULL)::INT), 0)::BIGINT AS additional_profile_fields, ((max(export_ts) - min(export_ts)) // 3600)::BIGINT AS profile_age_hours, coalesce(max((bio IS NOT NULL)::INT), 0)::BIGINT AS has_location_info FROM profile_with_addresses WHERE fid IS NOT NULL GROUP BY fid")
def profile_details(spark: SparkSession, d: str) -> DataFrame:
    return reputation.profile_details(V.profile_versions(spark, d))


@R.add(V.with_views("c", "SELECT fid, " + whole(unique_channels_followed="a.u", rapid_channel_follows="a.r", channel_memberships="m.n", unique_channel_memberships="m.u") + ", " + rounded(channel_follow_hour_std="h.sd", channel_follow_burst_ratio="coalesce(a.r, 0) / (coalesce(a.u, 0) + 1)", channel_engagement_ratio="coalesce(m.n, 0) / (coalesce(m.u, 0) + 1)")
    + " FROM (SELECT fid, count(DISTINCT parent_url) AS u, count(*) FILTER (gap_s < 60) AS r FROM g GROUP BY fid) a LEFT JOIN (SELECT fid, stddev_samp(n) AS sd FROM (SELECT fid, count(*) AS n FROM g GROUP BY fid, hour(timestamp)) GROUP BY fid) h USING (fid) FULL JOIN (SELECT fid, count(*) AS n, count(DISTINCT parent_url) AS u FROM c WHERE parent_url IS NOT NULL AND deleted_at IS NULL AND parent_hash IS NULL GROUP BY fid) m USING (fid)",
    _gaps("c", "parent_url IS NOT NULL AND deleted_at IS NULL")))
def channels_followed(spark: SparkSession, d: str) -> DataFrame:
    c = V.casts(spark, d, ["fid", "timestamp", "parent_url", "parent_hash", "deleted_at"]).where("parent_url IS NOT NULL").withColumnRenamed("parent_url", "channel_id")
    return reputation.channels_followed(c, c.where("parent_hash IS NULL"))


_LIST = "CASE WHEN json_valid(verified_addresses) THEN list_distinct(list_filter(CAST(json_extract_string(verified_addresses, '$[*]') AS VARCHAR[]), lambda a: starts_with(a, '0x') AND length(a) = 42)) ELSE [] END"


@R.add(V.with_views("p", f"SELECT fid, max(s.score) AS score FROM (SELECT fid, unnest(CASE WHEN len(a) = 0 THEN [NULL] ELSE a END) AS a FROM (SELECT fid, {_LIST} AS a FROM p)) x LEFT JOIN (SELECT substr(a, 3, 40) AS k, count(*)::DOUBLE AS score FROM (SELECT unnest({_LIST}) AS a FROM (SELECT DISTINCT * FROM profile_with_addresses WHERE fid IS NOT NULL)) GROUP BY 1) s ON s.k = substr(x.a, 3, 40) GROUP BY fid"))
def address_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of an address is here the number of profile rows that list it."""
    a = V.profiles(spark, d).select("fid", F.transform(address_list("verified_addresses"), lambda x: F.substring(x, 3, 40)).alias("addresses"))
    return reputation.address_scores(a, V.attested_scores(spark, d))


@R.add("SELECT fid, arg_max(fname, row(export_ts, fname)) AS fname FROM profile_with_addresses WHERE fid IS NOT NULL GROUP BY fid")
def latest_names(spark: SparkSession, d: str) -> DataFrame:
    return reputation.latest_names(table(spark, d, "profile_with_addresses").select("fid", "fname", F.col("export_ts").alias("updated_at")))


@R.add("SELECT DISTINCT id, coalesce(CASE WHEN json_valid(mentions) THEN TRY_CAST(json_extract_string(mentions, '$[0]') AS BIGINT) END, TRY_CAST(nullif(regexp_extract(CASE WHEN json_valid(embeds) THEN json_extract_string(embeds, '$[0].url') END, '[?&]fid=([^&#]*)', 1), '') AS BIGINT)) AS about FROM casts")
def target_of_cast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "casts").select("id", target_of("mentions", "embeds").alias("about")).distinct()


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Eight groups on the spine of profiled accounts, missing features 0; :func:`feature_matrix_all` has all."""
    # posts are told apart once with their texts and once without, so that texts are not carried through the gaps
    c, t = V.casts(spark, d, ["fid", "text", "parent_hash", "mentions", "deleted_at"]), V.casts(spark, d, ["fid", "timestamp", "deleted_at"])
    groups = [
        identity.profile(V.profiles(spark, d)),
        content.texts(c),
        content.mentions(c),
        temporal.timing(t),
        temporal.patterns(t),
        content.reactions(V.reactions(spark, d)),
        network.following(V.follows(spark, d)),
        network.counters(V.follow_counts(spark, d)),
    ]
    spine = V.profiles(spark, d).select("fid").distinct()
    out = left_joined(spine, groups)
    return out.na.fill(0)


_GROUPS = ["profile_completeness", "content_metrics", "mention_metrics", "temporal_timing", "burst_metrics", "reaction_patterns"]
R.queries["feature_matrix"] = feature_matrix
R.oracle["feature_matrix"] = V.with_views("p", "SELECT fid, coalesce(COLUMNS(* EXCLUDE (fid)), 0) FROM (SELECT DISTINCT fid FROM p) s\n"
    + "\n".join(f"LEFT JOIN ({R.oracle[n]}) USING (fid)" for n in _GROUPS) + f"\nLEFT JOIN (SELECT * EXCLUDE (avg_follow_latency_seconds) FROM ({R.oracle['network_basic']})) USING (fid)\nLEFT JOIN (SELECT * EXCLUDE (following_count) FROM ({R.oracle['first_last_snapshot']})) USING (fid)")

#: every implemented group with numbers by account; what else is registered are names, texts and matrices
_ALL = [n for n in R.queries if n not in ("latest_names", "target_of_cast", "feature_matrix")]
#: columns whose name an earlier group has; they get the group's name in front
_CLASH = {"network_basic": ["follow_velocity", "avg_follow_latency_seconds"], "first_last_snapshot": ["following_count"], "cast_style": ["link_usage_rate"], "engagement_metrics": ["influence_score"]}


def feature_sets(spark: SparkSession, d: str) -> FeatureRegistry:
    """A registry of every implemented group over the tables of a folder."""
    r = FeatureRegistry()
    for n in _ALL:
        g = R.queries[n](spark, d).withColumnsRenamed({c: f"{n}_{c}" for c in _CLASH.get(n, [])})
        r.register(FeatureSet(n, [c for c in g.columns if c != "fid"], lambda _, g=g: g))
    return r


def feature_matrix_all(spark: SparkSession, d: str) -> DataFrame:
    """Every implemented group on the spine of profiled accounts, missing features 0; seven groups are joined at a time."""
    return FeatureManager(feature_sets(spark, d), FeatureContext(spark, d), batch=7).matrix(V.profiles(spark, d))


_OWN = {n: "* EXCLUDE ({}), {}".format(", ".join(c), ", ".join(f"{x} AS {n}_{x}" for x in c)) for n, c in _CLASH.items()}
R.queries["feature_matrix_all"] = feature_matrix_all
R.oracle["feature_matrix_all"] = V.with_views("p", "SELECT fid, coalesce(COLUMNS(* EXCLUDE (fid)), 0) FROM (SELECT DISTINCT fid FROM p) s\n"
    + "\n".join(f"LEFT JOIN (SELECT {_OWN.get(n, '*')} FROM ({R.oracle[n]})) USING (fid)" for n in _ALL))
QUERIES, ORACLE = R.queries, R.oracle
