"""Curation of labels: from texts of a classifier account, by membership, and by re-labelling studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.text import hex_of, url_parameter
from rookery.ml.prepare import sample_n

# fixed values: what the classifier account writes
HUMAN = r"(?i)not a bot\."
BOT = r"(?i)like a bot|bot or low"


def target_of(mentions: Column | str, embeds: Column | str) -> Column:
    """The account a post is about: its first mention, else the fid parameter of its first embedded URL, else null."""
    first = F.get(F.from_json(mentions, "array<bigint>"), F.lit(0))
    url = F.get_json_object(embeds, "$[0].url")
    return F.coalesce(first, url_parameter(url, "fid").try_cast("bigint"))


def labels_from_texts(casts: DataFrame) -> DataFrame:
    """(fid, bot, cast_hash): one verdict per account from (text, mentions, embeds, hash).

    Of several verdicts a human one wins; texts that say neither are left out.
    """
    human = F.col("text").rlike(HUMAN)
    x = casts.where(human | F.col("text").rlike(BOT)).select(target_of("mentions", "embeds").alias("fid"), (~human).alias("bot"), hex_of("hash").alias("cast_hash"))
    x = x.where("fid IS NOT NULL")
    return x.groupBy("fid").agg(F.min("bot").alias("bot"), F.min_by("cast_hash", F.struct("bot", "cast_hash")).alias("cast_hash"))


def attach(df: DataFrame, positives: DataFrame, negatives: DataFrame, key: str = "fid") -> DataFrame:
    """``df`` with label 1, 0 or null by membership in two key sets; both make 1."""
    p = positives.select(key).distinct().withColumn("p__", F.lit(1))
    n = negatives.select(key).distinct().withColumn("n__", F.lit(0))
    return df.join(p, key, "left").join(n, key, "left").withColumn("label", F.coalesce("p__", "n__")).drop("p__", "n__")


def relabelled(df: DataFrame, n: int, key: str = "fid", label: str = "bot", seed: int = 42) -> DataFrame:
    """``df`` with all positive labels cleared and ``n`` pseudo-random unlabelled rows made positive."""
    cleared = df.withColumn(label, F.when(~F.col(label), F.col(label)))
    chosen = sample_n(cleared.where(F.col(label).isNull()).select(key), key, n, seed=seed).withColumn("c__", F.lit(True))
    return cleared.join(chosen, key, "left").withColumn(label, F.coalesce("c__", label)).drop("c__")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): how often two labels meet in each combination, nulls included."""
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def uncovered(wanted: DataFrame, have: DataFrame, key: str = "fid") -> DataFrame:
    """Keys of ``wanted`` that ``have`` lacks."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")
