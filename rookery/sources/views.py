"""The account-level data sets the features read, derived from the tables of a delivery folder.

Tables that a folder does not hold are stood in for by others of the same shape: orders serve as
verifications, order lines as storage purchases, error events as blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.text import address_list
from rookery.sources.tables import records, table

_CAST = ["fid", "text", "timestamp", "deleted_at", "parent_url", "parent_hash", "parent_fid", "root_parent_hash", "embeds", "mentions"]
_REACTION = ["fid", "reaction_type", "target_fid", "timestamp", "deleted_at"]


def casts(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    return records(table(spark, d, "casts").where("fid IS NOT NULL"), "id", columns or _CAST)


def reactions(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    return records(table(spark, d, "reactions").where("fid IS NOT NULL"), "id", columns or _REACTION)


def last_export(df: DataFrame) -> DataFrame:
    """The distinct rows of the newest export in a table."""
    newest = df.agg(F.max("export_ts").alias("x"))
    return df.join(F.broadcast(newest), F.col("export_ts") == F.col("x"), "left_semi").drop("export_ts").distinct()


def follows(spark: SparkSession, d: str) -> DataFrame:
    return last_export(table(spark, d, "follows")).where("fid IS NOT NULL AND target_fid IS NOT NULL")


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return last_export(table(spark, d, "profile_with_addresses")).where("fid IS NOT NULL")


def follow_counts(spark: SparkSession, d: str) -> DataFrame:
    """All exports: the history of the counters."""
    return table(spark, d, "follow_counts").where("fid IS NOT NULL").distinct()


def signers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "signers").where("fid IS NOT NULL").distinct()


def verifications(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("fid"),
        F.concat(F.lit('{"'), F.when(F.col("o_orderpriority").contains("URGENT"), "ethSignature").otherwise("signature"), F.lit('":"'), "o_orderpriority", F.lit('"}')).alias("claim"),
        F.substring("o_orderpriority", 1, 1).alias("platform"),
        F.col("o_orderdate").alias("timestamp"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"),
    )


def storage(spark: SparkSession, d: str) -> DataFrame:
    """(id, fid, units, timestamp, deleted_at); the id orders purchases of one moment."""
    line = table(spark, d, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return line.select(key.alias("id"), F.col("l_suppkey").alias("fid"), F.col("l_quantity").alias("units"), F.col("l_shipdate").alias("timestamp"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("deleted_at"))


def memberships(spark: SparkSession, d: str) -> DataFrame:
    """(fid, channel_id, deleted_at): posts that open a thread in a channel stand in for memberships."""
    return casts(spark, d, ["fid", "parent_url", "parent_hash", "deleted_at"]).where("parent_url IS NOT NULL AND parent_hash IS NULL").select("id", "fid", F.col("parent_url").alias("channel_id"), "deleted_at")


def profile_versions(spark: SparkSession, d: str) -> DataFrame:
    """(fid, url, location, created_at, updated_at) of the profile in every export; an export's end dates its rows."""
    p = table(spark, d, "profile_with_addresses").where("fid IS NOT NULL")
    at = F.timestamp_seconds("export_ts").cast("timestamp_ntz")
    return p.select("fid", F.col("avatar_url").alias("url"), F.col("bio").alias("location"), at.alias("created_at"), at.alias("updated_at")).distinct()


def attested_scores(spark: SparkSession, d: str) -> DataFrame:
    """(recipient, score): an address without its 0x, and how many profile rows of all exports list it."""
    p = table(spark, d, "profile_with_addresses").where("fid IS NOT NULL").distinct()
    a = p.select(F.explode(address_list("verified_addresses")).alias("a"))
    return a.groupBy(F.substring("a", 3, 40).alias("recipient")).agg(F.count(F.lit(1)).cast("double").alias("score"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.select(F.col("user_id").alias("blocker_fid"), F.get_json_object("props", "$.k").cast("bigint").alias("blocked_fid"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """(fid, bot): accounts of the newest export that follow more accounts than follow them; unlabelled where unknown."""
    c = last_export(table(spark, d, "follow_counts")).where("fid IS NOT NULL AND follower_count IS NOT NULL AND following_count IS NOT NULL")
    return c.groupBy("fid").agg((F.max("following_count") > F.max("follower_count")).alias("bot"))


# The same as SQL.
SQL = {
    "c": "SELECT DISTINCT id, " + ", ".join(_CAST) + " FROM casts WHERE fid IS NOT NULL",
    "r": "SELECT DISTINCT id, " + ", ".join(_REACTION) + " FROM reactions WHERE fid IS NOT NULL",
    "f": "SELECT DISTINCT fid, target_fid, timestamp, created_at, deleted_at FROM follows WHERE export_ts = (SELECT max(export_ts) FROM follows) AND fid IS NOT NULL AND target_fid IS NOT NULL",
    "p": "SELECT DISTINCT fid, fname, bio, avatar_url, verified_addresses, display_name FROM profile_with_addresses WHERE export_ts = (SELECT max(export_ts) FROM profile_with_addresses) AND fid IS NOT NULL",
    "fc": "SELECT DISTINCT * FROM follow_counts WHERE fid IS NOT NULL",
    "sg": "SELECT DISTINCT * FROM signers WHERE fid IS NOT NULL",
    "v": "SELECT o_orderkey AS id, o_custkey AS fid, concat('{\"', CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'ethSignature' ELSE 'signature' END, '\":\"', o_orderpriority, '\"}') AS claim, substr(o_orderpriority, 1, 1) AS platform, o_orderdate AS timestamp, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at FROM orders",
    "st": "SELECT row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_suppkey AS fid, l_quantity AS units, l_shipdate AS timestamp, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS deleted_at FROM lineitem",
    "bl": "SELECT user_id AS blocker_fid, CAST(json_extract(props, '$.k') AS BIGINT) AS blocked_fid FROM events WHERE event_type = 'error'",
    "lb": "SELECT fid, max(following_count) > max(follower_count) AS bot FROM follow_counts WHERE export_ts = (SELECT max(export_ts) FROM follow_counts) AND fid IS NOT NULL AND follower_count IS NOT NULL AND following_count IS NOT NULL GROUP BY fid",
}


def with_views(names: str, sql: str, more: str = "") -> str:
    """``sql`` with the views it names (and further definitions) in front."""
    parts = [f"{n} AS ({SQL[n]})" for n in names.split()]
    return "WITH " + ",\n".join(parts + ([more] if more else [])) + "\n" + sql
