"""Features of what an account writes and of the reactions around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.features.common import finish
from rookery.features.gaps import with_gaps, with_running_count
from rookery.functions.safe import count_if, scalars, sdiv
from rookery.functions.text import PATTERNS, count_of, has, json_list_size, share_of_symbol, words

# fixed values: the vocabulary the text features are defined by. Boundaries are ASCII, written out.
SPAM_WORDS = ["airdrop", "giveaway", "limited", "offer", "earn", "claim", "buy", "sell", "profit", "token", "moon", "urgent", "hurry"]
PROMOTION = ["check out", "click here", "sign up", "join now"]
CALLS = ["click", "join", "follow", "claim", "grab"]
URGENCY = ["hurry", "limited", "fast", "quick", "soon", "ending"]
LURES = ["airdrop", "money", "rewards", "claim", "moxie", "nft", "drop"]
AIRDROP = ["airdrop", "farm", "degen", "wojak"]
TEMPLATE = r"\[.*?\]|\{.*?\}|<.*?>"
EMOJI = r"[\x{1F300}-\x{1F9FF}]"


def _whole_words(terms: list[str]) -> str:
    return "(?<![A-Za-z0-9_])(" + "|".join(terms) + ")(?![A-Za-z0-9_])"


def _mean(p) -> object:
    return F.avg(F.coalesce(p, F.lit(False)).cast("int"))


def texts(casts: DataFrame) -> DataFrame:
    """Length, replies, links, vocabulary and originality of an account's live posts.

    Counts, lengths and shares are over live posts with a text; vocabulary (0 words without a text), originality
    and uniqueness over all live posts, in which a missing text is one more distinct text. Distinct texts are
    counted by the hash of the text, so no aggregate holds texts.
    """
    w = words("text")
    n_words = F.size(w)
    word_length = F.aggregate(w, F.lit(0), lambda s, x: s + F.char_length(x)).cast("double") / n_words
    known = F.col("text").isNotNull()
    x = casts.where("deleted_at IS NULL").select(
        "fid",
        (known & F.col("parent_hash").isNotNull()).alias("reply"),
        F.char_length("text").alias("len"),
        has("handle", "text").alias("handle"),
        count_of("link", "text").alias("links"),
        F.xxhash64("text").alias("h"),
        known.alias("known"),
        F.when(known, F.size(F.array_distinct(w))).alias("uniq"),
        F.when(known, n_words).alias("nw"),
        F.when(known, word_length * F.size(F.split("text", r"\.", -1))).alias("complexity"),
    )
    a = x.groupBy("fid").agg(
        count_if(F.col("known")).alias("cast_count"),
        F.count(F.lit(1)).alias("n"),
        F.avg("len").alias("avg_cast_length"),
        count_if(F.col("reply")).alias("reply_count"),
        count_if(F.col("handle")).alias("mention_count"),
        F.sum("links").alias("links"),
        F.avg(F.col("uniq") / (F.col("nw") + 1)).alias("content_type_diversity"),
        F.avg("complexity").alias("content_complexity"),
        F.avg(F.coalesce("uniq", F.lit(0))).alias("vocabulary_richness"),
        F.avg("links").alias("hashtag_usage"),
        (F.count_distinct(F.when(F.col("known"), F.col("h"))) + F.max((~F.col("known")).cast("int"))).alias("nu"),
    )
    out = a.withColumns({"link_usage_rate": sdiv("links", "cast_count"), "content_originality": sdiv("nu", "cast_count"), "content_uniqueness": sdiv("nu", "n")})
    return finish(out.drop("links", "nu", "n"))


def mentions(casts: DataFrame) -> DataFrame:
    """Mentions (a JSON array) in an account's live posts with a text, and the share of those with each suspicious pattern."""
    m = json_list_size("mentions")
    a = casts.where("deleted_at IS NULL AND text IS NOT NULL").groupBy("fid").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(m).alias("total_mentions"),
        count_if(m > 0).alias("casts_with_mentions"),
        F.avg(m).alias("avg_mentions_per_cast"),
        _mean(has("emoji_run", "text")).alias("emoji_spam_ratio"),
        _mean(has("price", "text")).alias("price_mention_ratio"),
        _mean(has("excessive_symbols", "text")).alias("symbol_spam_ratio"),
        _mean(has("airdrop_terms", "text")).alias("airdrop_term_ratio"),
    )
    return finish(a.withColumn("mention_frequency", sdiv("casts_with_mentions", "n")).drop("n"))


def spam(casts: DataFrame) -> DataFrame:
    """Spam vocabulary, promotion, odd patterns and quick posting of live posts."""
    g = with_gaps(casts.where("deleted_at IS NULL"), "fid", "timestamp", "id")
    c = lambda p: F.sum(F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)))
    a = g.groupBy("fid").agg(
        F.count(F.lit(1)).alias("n"), c(_whole_words(SPAM_WORDS)).alias("s"), c(_whole_words(PROMOTION)).alias("p"), c(PATTERNS["suspicious"]).alias("x"), count_if(F.col("gap_s") < 60).alias("rapid")
    )
    return finish(
        a.select(
            "fid",
            sdiv("s", "n").alias("spam_keyword_ratio"),
            sdiv("p", "n").alias("promotional_ratio"),
            sdiv("x", "n").alias("suspicious_pattern_ratio"),
            sdiv("rapid", "n").alias("rapid_post_ratio"),
            sdiv(F.col("s") + 2 * F.col("p") + 1.5 * F.col("x"), "n").alias("spam_score"),
        )
    )


def style(casts: DataFrame) -> DataFrame:
    """Links, media, symbol shares and calls to action of an account's live posts; patterns see lower-cased text."""
    low = F.lower("text")
    inside = lambda x: F.coalesce(F.contains(low, F.lit(x)), F.lit(False)).cast("int")
    links = inside("http://") + inside("https://") + inside("www.")
    media = F.coalesce(F.regexp_count(F.lower("embeds"), F.lit("image")), F.lit(0))
    x = casts.where("deleted_at IS NULL").select("fid", "text", low.alias("low"), links.alias("l"), media.alias("m"))
    a = x.groupBy("fid").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l").alias("total_links"),
        count_if(F.col("l") > 0).alias("casts_with_links"),
        F.sum("m").alias("total_media"),
        count_if(F.col("m") > 0).alias("casts_with_media"),
        count_if((F.col("l") > 0) & (F.col("m") > 0)).alias("casts_with_both"),
        F.avg(share_of_symbol("text", "@")).alias("avg_at_symbol_ratio"),
        F.avg(share_of_symbol("text", "$")).alias("avg_dollar_symbol_ratio"),
        *[F.sum(F.coalesce(F.regexp_count("low", F.lit(w)), F.lit(0))).alias(f"lure_{w}") for w in LURES],
        _mean(F.col("low").rlike("|".join(AIRDROP))).alias("airdrop_mention_ratio"),
        _mean(F.col("low").rlike(TEMPLATE)).alias("template_usage_ratio"),
        _mean(F.regexp_count("low", F.lit("|".join(CALLS))) > 2).alias("cta_heavy_ratio"),
        _mean(F.col("low").rlike("|".join(URGENCY))).alias("urgency_ratio"),
        _mean(F.regexp_count("low", F.lit(EMOJI)) > 5).alias("emoji_heavy_ratio"),
    )
    return finish(
        a.withColumns(
            {
                "multimedia_ratio": sdiv("casts_with_both", "n"),
                "link_usage_rate": sdiv("casts_with_links", "n"),
                "media_usage_rate": sdiv("casts_with_media", "n"),
                "avg_links_per_link_cast": sdiv("total_links", "casts_with_links"),
                "avg_media_per_media_cast": sdiv("total_media", "casts_with_media"),
            }
        ).drop("n")
    )


def conversation(casts: DataFrame) -> DataFrame:
    """How the account takes part in threads; live posts, running replies ordered by (timestamp, id)."""
    live = casts.where("deleted_at IS NULL AND timestamp IS NOT NULL")
    x = with_running_count(live, "fid", "timestamp", "id", "parent_hash", "depth")
    a = x.groupBy("fid").agg(
        _mean(F.col("parent_hash").isNull()).alias("conversation_initiation_rate"),
        F.avg("depth").alias("conversation_depth"),
        _mean(F.col("text").isNotNull()).alias("thread_participation"),
        F.count_distinct("parent_fid").alias("parent_fid_diversity"),
        _mean(F.col("root_parent_hash").isNotNull()).alias("root_thread_participation"),
        _mean(F.col("embeds").isNotNull()).alias("embed_usage_ratio"),
    )
    return finish(a)


def replies(casts: DataFrame) -> DataFrame:
    """Replies of an account: to how many accounts, and the pauses between them."""
    g = with_gaps(casts.where("deleted_at IS NULL AND parent_fid IS NOT NULL"), "fid", "timestamp", "id")
    a = g.groupBy("fid").agg(
        F.count(F.lit(1)).alias("total_replies"),
        F.count_distinct("parent_fid").alias("unique_users_replied_to"),
        F.avg("gap_s").alias("avg_seconds_between_replies"),
        F.stddev_samp("gap_s").alias("std_seconds_between_replies"),
    )
    return finish(a.withColumns({"reply_diversity": sdiv("unique_users_replied_to", F.col("total_replies") + 1), "reply_timing_variability": sdiv("std_seconds_between_replies", F.col("avg_seconds_between_replies") + 1)}))


def reactions(reacts: DataFrame) -> DataFrame:
    """Live reactions an account gave: kinds, pace and diversity of targets."""
    g = with_gaps(reacts.where("deleted_at IS NULL"), "fid", "timestamp", "id")
    a = g.groupBy("fid").agg(
        F.count(F.lit(1)).alias("total_reactions"),
        count_if(F.col("reaction_type") == 1).alias("like_count"),
        count_if(F.col("reaction_type") == 2).alias("recast_count"),
        F.count_distinct("target_fid").alias("unique_users_reacted_to"),
        F.avg("gap_h").alias("avg_hours_between_reactions"),
        F.stddev_samp("gap_h").alias("std_hours_between_reactions"),
    )
    n, lk, rc = F.col("total_reactions"), F.col("like_count"), F.col("recast_count")
    return finish(
        a.withColumns(
            {
                "like_ratio": sdiv(lk, n),
                "recast_ratio": sdiv(rc, n),
                "reaction_diversity": sdiv("unique_users_reacted_to", n + 1),
                "likes_to_recasts_ratio": sdiv(lk, rc + 1),
                "viral_coefficient": sdiv(rc, n + 1),
            }
        )
    )


def _last_followers(history: DataFrame) -> DataFrame:
    """(fid, followers, following) of the newest counters."""
    o = F.struct("created_at", "export_ts")
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), o))
    return history.groupBy("fid").agg(last("follower_count").alias("followers"), last("following_count").alias("following"))


def engagement(casts: DataFrame, reacts: DataFrame, history: DataFrame, members: DataFrame) -> DataFrame:
    """Reactions against followers, influence, reach and the balance of creating and consuming.

    Live posts, live reactions given, the newest counters and live channel memberships (fid, deleted_at); each
    input is one row per account before they meet.
    """
    c = casts.where("deleted_at IS NULL").groupBy("fid").agg(F.count(F.lit(1)).alias("casts"))
    r = reacts.where("deleted_at IS NULL").groupBy("fid").agg(F.count(F.lit(1)).alias("reacts"), F.count_distinct("target_fid").alias("reach"))
    m = members.where("deleted_at IS NULL AND fid IS NOT NULL").groupBy("fid").agg(F.count(F.lit(1)).alias("member"))
    # the scatter of all accounts' totals, a scalar
    all_ = scalars(r.agg(sdiv(F.stddev_samp("reacts"), F.avg("reacts") + 1).alias("v")))("v")
    j = c.join(r, "fid", "full").join(_last_followers(history), "fid", "left").join(m, "fid", "left")
    reacted = F.col("reacts").isNotNull()
    j = j.withColumn("consistency", F.when(reacted, all_)).na.fill(0)
    return finish(
        j.select(
            "fid",
            sdiv("reacts", F.col("followers") + 1).alias("engagement_rate"),
            sdiv("reach", F.col("followers") + 1).alias("audience_reach"),
            F.col("consistency").alias("engagement_consistency"),
            F.col("reach").alias("reach_metrics"),
            sdiv("reacts", "casts").alias("engagement_impact"),
            sdiv(0.4 * F.col("followers") + 0.3 * F.col("reacts") + 0.3 * F.col("casts"), F.col("following") + 1).alias("influence_score"),
            sdiv(F.col("casts") + F.col("reacts") + F.col("member"), 3).alias("engagement_score"),
            sdiv("casts", F.col("reacts") + 1).alias("creation_consumption_ratio"),
            sdiv("reach", F.col("reacts") + 1).alias("interaction_diversity"),
        )
    )


def received(reacts: DataFrame, casts: DataFrame, history: DataFrame) -> DataFrame:
    """Live reactions an account receives against its live posts: virality, influence, retention and their composite.

    Engagement quality weighs reactions by the share of the greatest number of reactors, which for one account
    is 1; sustainability is 1 from two posts on, as an account has one total, and undefined (0) for one post.
    """
    pairs = reacts.where("deleted_at IS NULL AND target_fid IS NOT NULL").groupBy("target_fid", "fid").agg(F.count(F.lit(1)).alias("n"))
    got = pairs.groupBy(F.col("target_fid").alias("fid")).agg(F.sum("n").alias("reactions_received"), F.count(F.lit(1)).alias("unique_reactors"))
    c = casts.where("deleted_at IS NULL").groupBy("fid").agg(F.count(F.lit(1)).alias("casts"))
    j = c.join(got, "fid", "left").na.fill(0).join(_last_followers(history), "fid", "left")
    n, u = F.col("reactions_received"), F.col("unique_reactors")
    x = j.select(
        "fid",
        "reactions_received",
        "unique_reactors",
        sdiv(n, "casts").alias("content_virality"),
        sdiv(u, "casts").alias("influence_per_cast"),
        F.when(u > 0, sdiv(n, "casts")).alias("weighted_engagement_quality"),
        F.when(F.col("casts") > 1, F.lit(1.0)).alias("content_sustainability"),
        sdiv(u, F.col("followers") + 1).alias("audience_retention"),
    )
    parts = 0.3 * F.col("content_virality") + 0.3 * F.col("weighted_engagement_quality") + 0.2 * F.col("content_sustainability") + 0.2 * F.coalesce("audience_retention", F.lit(0.0))
    return finish(x.withColumn("content_effectiveness", parts))


def power_interactions(casts: DataFrame, reacts: DataFrame, power: DataFrame) -> DataFrame:
    """Replies to, mentions of and reactions to the accounts in ``power`` (one column, fid), per account.

    Membership is a join whose strategy depends on the size of ``power``; mentions are parsed, not matched
    as text, and each post counts once however many such accounts it mentions.
    """
    p = power.select(F.col("fid").alias("pf")).distinct()
    base = casts.where("deleted_at IS NULL").select("id", "fid", "parent_fid", "mentions")
    rep = base.join(p, F.col("parent_fid") == F.col("pf"), "left_semi").groupBy("fid").agg(F.count(F.lit(1)).alias("power_user_replies"))
    named = base.select("id", "fid", F.explode(F.from_json("mentions", "array<bigint>")).alias("m")).join(p, F.col("m") == F.col("pf"), "left_semi")
    men = named.select("id", "fid").distinct().groupBy("fid").agg(F.count(F.lit(1)).alias("power_user_mentions"))
    live = reacts.where("deleted_at IS NULL")
    rea = live.join(p, F.col("target_fid") == F.col("pf"), "left_semi").groupBy("fid").agg(F.count(F.lit(1)).alias("power_user_reactions"))
    total = base.groupBy("fid").agg(F.count(F.lit(1)).alias("c")).join(live.groupBy("fid").agg(F.count(F.lit(1)).alias("r")), "fid", "full")
    j = total.join(rep, "fid", "left").join(men, "fid", "left").join(rea, "fid", "left").na.fill(0)
    every = F.col("power_user_replies") + F.col("power_user_mentions") + F.col("power_user_reactions")
    return finish(j.select("fid", "power_user_replies", "power_user_mentions", "power_user_reactions", sdiv(every, F.col("c") + F.col("r") + 1).alias("power_user_interaction_ratio")))
