"""Queries for the relational operators, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.features.gaps import with_gaps, with_running_count
from rookery.functions import text as X
from rookery.functions.safe import count_if, nunique, sdiv
from rookery.functions.timex import iso_weekday
from rookery.operators import relational as O
from rookery.plans.registry import Registry
from rookery.session import shared_dir
from rookery.sources import datasets as D
from rookery.sources import views as V
from rookery.sources.tables import table

R = Registry()


@R.add("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity < 10 AND l_returnflag IN ('A', 'R')")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ'1997-01-01' AND l_quantity < 10 AND l_returnflag IN ('A', 'R')")
    return t.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@R.add("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ'2000-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@R.add("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add(V.with_views("c", "SELECT fid, count(*) AS live FROM c WHERE deleted_at IS NULL GROUP BY fid"))
def soft_delete_filter(spark: SparkSession, d: str) -> DataFrame:
    return V.casts(spark, d, ["fid", "deleted_at"]).where("deleted_at IS NULL").groupBy("fid").agg(F.count(F.lit(1)).alias("live"))


@R.add("SELECT DISTINCT fid, CASE WHEN fid = target_fid THEN 'self' WHEN deleted_at IS NULL THEN 'live' ELSE 'gone' END AS state FROM follows WHERE fid IS NOT NULL AND timestamp IS NOT NULL AND NOT (hour(timestamp) BETWEEN 9 AND 22)")
def predicates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "follows").where(F.col("fid").isNotNull() & F.col("timestamp").isNotNull() & ~F.hour("timestamp").between(9, 22))
    return t.select("fid", F.when(F.col("fid") == F.col("target_fid"), "self").when(F.col("deleted_at").isNull(), "live").otherwise("gone").alias("state")).distinct()


@R.add(V.with_views("p c", "SELECT s.fid, coalesce(n, 0) AS casts FROM (SELECT DISTINCT fid FROM p) s LEFT JOIN (SELECT fid, count(*) AS n FROM c GROUP BY 1) USING (fid)"))
def spine_left_join(spark: SparkSession, d: str) -> DataFrame:
    n = V.casts(spark, d, ["fid"]).groupBy("fid").agg(F.count(F.lit(1)).alias("casts"))
    return V.profiles(spark, d).select("fid").distinct().join(n, "fid", "left").na.fill(0)


@R.add(V.with_views("p lb", "SELECT DISTINCT fid, fname, bot FROM p JOIN lb USING (fid)"))
def inner_labels(spark: SparkSession, d: str) -> DataFrame:
    return V.profiles(spark, d).join(V.labels(spark, d), "fid").select("fid", "fname", "bot").distinct()


@R.add(V.with_views("p", "SELECT DISTINCT fid FROM casts WHERE fid IN (SELECT fid FROM p)"))
def semi_membership(spark: SparkSession, d: str) -> DataFrame:
    return O.keep(table(spark, d, "casts", ["fid"]), "fid", V.profiles(spark, d)).distinct()


@R.add("SELECT DISTINCT target_fid FROM reactions WHERE target_fid IS NULL OR NOT EXISTS (SELECT 1 FROM signers s WHERE s.fid = target_fid)")
def anti_membership(spark: SparkSession, d: str) -> DataFrame:
    return O.without(table(spark, d, "reactions", ["target_fid"]), "target_fid", V.signers(spark, d), "fid").distinct()


@R.add("SELECT fid FROM casts WHERE fid IS NOT NULL EXCEPT SELECT fid FROM reactions")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "casts", ["fid"]).where("fid IS NOT NULL").subtract(table(spark, d, "reactions", ["fid"]))


@R.add("SELECT fid FROM casts INTERSECT SELECT fid FROM reactions")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "casts", ["fid"]).intersect(table(spark, d, "reactions", ["fid"]))


@R.add("SELECT fid, timestamp, CAST(NULL AS INT) AS reaction_type, 'cast' AS kind FROM casts WHERE deleted_at IS NOT NULL UNION ALL SELECT fid, timestamp, reaction_type, 'reaction' FROM reactions WHERE deleted_at IS NOT NULL")
def union_relaxed(spark: SparkSession, d: str) -> DataFrame:
    gone = F.col("deleted_at").isNotNull()
    c = table(spark, d, "casts").where(gone).select("fid", "timestamp", F.lit("cast").alias("kind"))
    r = table(spark, d, "reactions").where(gone).select("fid", "timestamp", "reaction_type", F.lit("reaction").alias("kind"))
    return D.union_relaxed([c, r])


@R.add("SELECT parent_url, count(*) AS n, count(fid) AS with_fid, min(timestamp) AS first, max(timestamp) AS last FROM casts GROUP BY parent_url")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "casts").groupBy("parent_url").agg(F.count(F.lit(1)).alias("n"), F.count("fid").alias("with_fid"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@R.add("SELECT fid, count(DISTINCT target_fid) + max((target_fid IS NULL)::INT)::BIGINT AS targets FROM reactions WHERE fid IS NOT NULL GROUP BY fid")
def distinct_counts_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reactions").where("fid IS NOT NULL").groupBy("fid").agg(nunique("target_fid").alias("targets"))


@R.add(V.with_views("r", "SELECT fid, count(*) FILTER (reaction_type = 1) AS likes, count(*) FILTER (reaction_type = 2 AND deleted_at IS NULL) AS live_recasts, round(count(*) FILTER (reaction_type = 1) / count(*), 6) AS like_share FROM r GROUP BY fid"))
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    like = count_if(F.col("reaction_type") == 1)
    return V.reactions(spark, d).groupBy("fid").agg(like.alias("likes"), count_if((F.col("reaction_type") == 2) & F.col("deleted_at").isNull()).alias("live_recasts"), F.round(sdiv(like, F.count(F.lit(1))), 6).alias("like_share"))


@R.add(V.with_views("r", "SELECT fid, nullif(count(*) FILTER (reaction_type = 1), 0) AS likes, nullif(count(*) FILTER (reaction_type = 2), 0) AS recasts FROM r GROUP BY fid"))
def pivot_reactions(spark: SparkSession, d: str) -> DataFrame:
    return O.pivot_counts(V.reactions(spark, d), "fid", "reaction_type", {"likes": 1, "recasts": 2})


@R.add("SELECT fid, string_agg(lower(fname), ' ' ORDER BY export_ts, fname) AS fname FROM (SELECT DISTINCT fid, export_ts, fname FROM profile_with_addresses) WHERE fname IS NOT NULL GROUP BY fid")
def string_agg_tokens(spark: SparkSession, d: str) -> DataFrame:
    return O.tokens_of_group(table(spark, d, "profile_with_addresses", ["fid", "export_ts", "fname"]).distinct(), "fid", "fname", ["export_ts", "fname"]).select("fid", "fname")


_LAG = "lag(timestamp) OVER (PARTITION BY fid ORDER BY timestamp, id)"


@R.add(V.with_views("c", f"SELECT fid, id, date_sub('second', {_LAG}, timestamp) AS gap_s, date_sub('minute', {_LAG}, timestamp) AS gap_m, date_sub('hour', {_LAG}, timestamp) AS gap_h FROM c WHERE timestamp IS NOT NULL"))
def gap_stats(spark: SparkSession, d: str) -> DataFrame:
    return with_gaps(V.casts(spark, d, ["fid", "timestamp"]), "fid", "timestamp", "id").select("fid", "id", "gap_s", "gap_m", "gap_h")


@R.add(V.with_views("c", "SELECT id, count(parent_hash) OVER (PARTITION BY fid ORDER BY timestamp NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS replies_so_far FROM c"))
def running_count(spark: SparkSession, d: str) -> DataFrame:
    return with_running_count(V.casts(spark, d, ["fid", "timestamp", "parent_hash"]), "fid", "timestamp", "id", "parent_hash", "replies_so_far").select("id", "replies_so_far")


@R.add("SELECT event_id, count(*) OVER (PARTITION BY event_type) AS same_type, round(value / sum(value) OVER (PARTITION BY user_id), 6) AS share FROM events")
def partition_count(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", ["event_id", "event_type", "user_id", "value"])
    x = O.with_totals(O.with_totals(e, "event_type", same_type=F.count(F.lit(1))), "user_id", total=F.sum("value"))
    return x.select("event_id", "same_type", F.round(F.col("value") / F.col("total"), 6).alias("share"))


@R.add("SELECT fid, export_ts, created_at, follower_count, following_count FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY created_at DESC NULLS LAST, export_ts DESC, follower_count DESC NULLS LAST, following_count DESC NULLS LAST) AS r FROM follow_counts WHERE fid IS NOT NULL) WHERE r = 1")
def latest_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    return O.latest(table(spark, d, "follow_counts"), "fid", ["created_at", "export_ts"]).select("fid", "export_ts", "created_at", "follower_count", "following_count")


@R.add("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    return O.top_per_group(table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_totalprice"]), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@R.add("SELECT fid, follower_count FROM (SELECT fid, max(follower_count) AS follower_count FROM follow_counts WHERE fid IS NOT NULL GROUP BY fid) ORDER BY follower_count DESC NULLS LAST, fid LIMIT 50")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "follow_counts").where("fid IS NOT NULL").groupBy("fid").agg(F.max("follower_count").alias("follower_count"))
    return t.orderBy(F.desc_nulls_last("follower_count"), "fid").limit(50)


@R.add("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40")
def slice_rows(spark: SparkSession, d: str) -> DataFrame:
    return O.page(table(spark, d, "customer"), ["c_acctbal", "c_custkey"], 40, 20).select("c_custkey", "c_name")


@R.add("SELECT fid, fname FROM (SELECT DISTINCT fid, fname FROM profile_with_addresses) WHERE fname IN (SELECT fname FROM (SELECT DISTINCT fid, fname FROM profile_with_addresses) GROUP BY 1 HAVING count(*) > 1)")
def duplicated_values(spark: SparkSession, d: str) -> DataFrame:
    return O.duplicated(table(spark, d, "profile_with_addresses", ["fid", "fname"]).distinct(), "fname")


@R.add("SELECT id, CASE reaction_type WHEN 1 THEN 'like' WHEN 2 THEN 'recast' ELSE 'unknown' END AS kind FROM (SELECT DISTINCT id, reaction_type FROM reactions)")
def replaced_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reactions", ["id", "reaction_type"]).distinct().select("id", O.replaced("reaction_type", {1: "like", 2: "recast"}, "unknown").alias("kind"))


@R.add(V.with_views("c", "SELECT fid, count(*) AS n FROM c WHERE timestamp > (SELECT max(timestamp) - INTERVAL 1 MONTH FROM c) GROUP BY fid"))
def active_last_month(spark: SparkSession, d: str) -> DataFrame:
    return O.newer_than(V.casts(spark, d, ["fid", "timestamp"]), "timestamp", 1).groupBy("fid").agg(F.count(F.lit(1)).alias("n"))


@R.add("""SELECT 'l_quantity' AS "column", count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
UNION ALL SELECT 'l_discount', count(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount), max(l_discount) FROM lineitem""")
def describe(spark: SparkSession, d: str) -> DataFrame:
    return O.described(table(spark, d, "lineitem"), ["l_quantity", "l_discount"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@R.add(V.with_views("c", "SELECT hour(timestamp) AS hour, isodow(timestamp) AS weekday, count(*) AS n FROM c WHERE timestamp IS NOT NULL GROUP BY ALL"))
def temporal_distribution(spark: SparkSession, d: str) -> DataFrame:
    t = V.casts(spark, d, ["fid", "timestamp"]).where("timestamp IS NOT NULL")
    return t.groupBy(F.hour("timestamp").cast("bigint").alias("hour"), iso_weekday("timestamp").cast("bigint").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


@R.add(r"SELECT doc_id, regexp_matches(text, '[0-9]{4,}') AS numbers, regexp_matches(text, '(?i)\b(airdrop|farm|degen|wojak)\b') AS airdrop, regexp_matches(text, '\b(19|20)[0-9]{2}\b') AS has_year, regexp_matches(text, 'https?://') AS link FROM documents")
def regex_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.has("random_numbers", "text").alias("numbers"), X.has("airdrop_terms", "text").alias("airdrop"), X.has("has_year", "text").alias("has_year"), X.has("link", "text").alias("link"))


@R.add(r"SELECT doc_id, len(regexp_extract_all(text, '@[A-Za-z0-9_]+')) AS handles, len(regexp_extract_all(text, '[!$@#%]{2,}|[0-9]{10,}|[A-Z]{5,}')) AS suspicious, len(regexp_extract_all(text, 'https?://')) AS links FROM documents")
def regex_counts(spark: SparkSession, d: str) -> DataFrame:
    c = lambda p: X.count_of(p, "text").cast("bigint").alias({"handle": "handles", "link": "links"}.get(p, p))
    return table(spark, d, "documents").select("doc_id", c("handle"), c("suspicious"), c("link"))


@R.add("SELECT doc_id, round(len(list_distinct(list_filter(string_split(lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')), ''), lambda c: c <> ''))) / (length(text) + 1), 6) AS diversity FROM documents")
def char_diversity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(X.char_diversity("text"), 6).alias("diversity"))


@R.add("SELECT doc_id, len(string_split(text, ' ')) AS words, len(list_distinct(string_split(text, ' '))) AS distinct_words, len(string_split(text, '.')) AS sentences, length(text) AS chars FROM documents")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    w = X.words("text")
    some = lambda c: F.when(F.col("text").isNotNull(), c.cast("bigint"))
    return table(spark, d, "documents").select("doc_id", some(F.size(w)).alias("words"), some(F.size(F.array_distinct(w))).alias("distinct_words"), some(F.size(F.split("text", r"\.", -1))).alias("sentences"), F.char_length("text").cast("bigint").alias("chars"))


@R.add("SELECT DISTINCT id, CASE WHEN json_valid(mentions) THEN coalesce(json_array_length(mentions)::BIGINT, 0) ELSE 0 END AS mentions FROM casts")
def json_mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "casts", ["id", "mentions"]).select("id", X.json_list_size("mentions").cast("bigint").alias("mentions")).distinct()


@R.add("SELECT DISTINCT id, CASE WHEN json_valid(embeds) THEN json_extract_string(embeds, '$[0].url') END AS url FROM casts")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "casts", ["id", "embeds"]).select("id", F.get_json_object("embeds", "$[0].url").alias("url")).distinct()


@R.add("SELECT doc_id, nullif(regexp_extract('https://x.example/p?a=1&fid=' || doc_id || '&z=2', '[?&]fid=([^&#]*)', 1), '') AS fid FROM documents")
def url_param(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://x.example/p?a=1&fid="), F.col("doc_id").cast("string"), F.lit("&z=2"))
    return table(spark, d, "documents").select("doc_id", X.url_parameter(url, "fid").alias("fid"))


@R.add("SELECT DISTINCT id, '0x' || lower(hex(hash)) AS cast_hash FROM casts")
def hex_render(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "casts", ["id", "hash"]).select("id", X.hex_of("hash").alias("cast_hash")).distinct()


_LIST = "CASE WHEN json_valid(verified_addresses) THEN list_distinct(list_filter(CAST(json_extract_string(verified_addresses, '$[*]') AS VARCHAR[]), lambda a: starts_with(a, '0x') AND length(a) = 42)) ELSE [] END"


@R.add(V.with_views("p", "SELECT a AS address, count(DISTINCT fid) AS n_accounts FROM x GROUP BY a", f"x AS (SELECT fid, unnest({_LIST}) AS a FROM p)"))
def shared_addresses(spark: SparkSession, d: str) -> DataFrame:
    x = V.profiles(spark, d).select("fid", F.explode(X.address_list("verified_addresses")).alias("address")).distinct()
    return x.groupBy("address").agg(F.count(F.lit(1)).alias("n_accounts"))


@R.add("SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def medians(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))


@R.add("SELECT user_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_days(spark: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.col("ts").cast("date")).cast("bigint")
    return table(spark, d, "events").groupBy("user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _round_trip(spark: SparkSession, df: DataFrame, kind: str) -> DataFrame:
    path = f"{shared_dir(spark)}/rookery-{kind}-{uuid.uuid4().hex}"
    if kind == "csv":
        # texts hold quotes, line breaks and nothing at all: quotes are doubled, null and empty are told apart
        how = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "nullValue": "\\N", "emptyValue": "", "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        df.write.options(**how).csv(path)
        return spark.read.options(**how).csv(path, schema=df.schema)
    df.write.format(kind).save(path)
    return spark.read.schema(df.schema).format(kind).load(path)


@R.add("SELECT id, fid, text, embeds FROM casts")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, table(spark, d, "casts", ["id", "fid", "text", "embeds"]), "csv")


@R.add("SELECT id, fid, text, embeds FROM casts")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, table(spark, d, "casts", ["id", "fid", "text", "embeds"]), "json")


@R.add("SELECT DISTINCT fid AS src, target_fid AS dst FROM follows WHERE fid IS NOT NULL AND target_fid IS NOT NULL")
def edge_list_round_trip(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "follows").where("fid IS NOT NULL AND target_fid IS NOT NULL").select(F.col("fid").alias("src"), F.col("target_fid").alias("dst")).distinct()
    path = f"{shared_dir(spark)}/rookery-edges-{uuid.uuid4().hex}"
    D.write_edges(e, path)
    return D.read_edges(spark, path).select("src", "dst")


@R.add("SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 250000 THEN 'big' ELSE o_orderpriority END AS note FROM orders")
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/rookery-upsert-{uuid.uuid4().hex}"
    o = table(spark, d, "orders")
    D.upsert(o.select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("note")), path, "o_orderkey")
    D.upsert(o.where("o_totalprice > 250000").select("o_orderkey", "o_orderstatus", F.lit("big").alias("note")), path, "o_orderkey")
    return spark.read.parquet(path)


QUERIES, ORACLE = R.queries, R.oracle
