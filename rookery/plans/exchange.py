"""Queries for loading, exchange formats, streams and validation: what goes out and comes back over whole tables."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.safe import sdiv
from rookery.functions.text import hex_amount, hex_whole
from rookery.functions.timex import micros
from rookery.ml import metrics as M
from rookery.ml import prepare as P
from rookery.ml import scoring as S
from rookery.ml.labels import attach
from rookery.plans.learning import _scores, _sql
from rookery.plans.registry import Registry
from rookery.session import shared_dir
from rookery.sources import datasets as D
from rookery.sources import views as V
from rookery.sources.tables import records, table
from rookery.streaming.sessions import stream_sessions

R = Registry()


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rookery-{name}-{uuid.uuid4().hex}"


@R.add("SELECT DISTINCT fid, follower_count, following_count FROM follow_counts WHERE export_ts = (SELECT max(export_ts) FROM follow_counts) AND fid IN (SELECT fid FROM signers)")
def newest_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Every export is delivered as a file of its own; the newest is read, some columns, restricted to known accounts."""
    t, folder = table(spark, d, "follow_counts"), _path(spark, "deliveries")
    for at in sorted(r[0] for r in t.select("export_ts").distinct().collect()):  # one number per full export
        t.where(F.col("export_ts") == at).withColumn("void", F.lit(None)).transform(D.scrub, ["export_ts"]).write.parquet(f"{folder}/export-follow_counts-0-{at}.parquet")
    c = D.DatasetCatalog(spark, folder)
    columns = [x for x in c.columns("follow_counts") if x.endswith("_count")]
    return c.load("follow_counts", columns=columns, fids=V.signers(spark, d)).distinct()


@R.add("SELECT DISTINCT fid FROM (SELECT fid FROM (SELECT DISTINCT fid FROM casts WHERE fid IS NOT NULL ORDER BY fid LIMIT 500) UNION ALL SELECT unnest([-5, 7])::BIGINT)")
def account_spine(spark: SparkSession, d: str) -> DataFrame:
    """The spine of a limited run: the smallest keys and those asked for."""
    return D.spine(table(spark, d, "casts", ["fid"]), "fid", 500, [-5, 7])


@R.add("SELECT fid, coalesce(bio, '(none)') AS bio, 0 AS badges FROM (SELECT DISTINCT fid, bio FROM profile_with_addresses WHERE fid IS NOT NULL)")
def profile_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Columns that a delivery lacks are added, nulls of the others filled."""
    p = table(spark, d, "profile_with_addresses", ["fid", "bio"]).where("fid IS NOT NULL").distinct()
    return D.with_defaults(D.validate(p, ["fid", "bio"]), {"bio": "(none)", "badges": 0})


@R.add(_sql("SELECT printf('%d %.10f', fid, p1) AS value FROM sc WHERE p1 IS NOT NULL"))
def posterior_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "posteriors")
    D.write_posteriors(_scores(spark, d).where("p1 IS NOT NULL"), path, "fid", "p1")
    return spark.read.text(path)


@R.add(V.with_views("lb", "SELECT fid AS id, NOT bot AS positive FROM (SELECT *, row_number() OVER (PARTITION BY bot ORDER BY (fid * 2654435761) % 4294967296, fid) AS r FROM lb) WHERE r <= 300"))
def seed_file(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of a propagation, 300 per class, written as a line of positive and a line of negative ids and read again."""
    s = P.sample_n(V.labels(spark, d).where("bot IS NOT NULL"), "fid", 300, by="bot")
    line = lambda b: F.array_join(F.array_sort(F.collect_list(F.when(F.col("bot") == b, F.col("fid")))), " ")
    path = _path(spark, "seeds")
    s.agg(F.concat_ws("\n", line(False), line(True)).alias("value")).coalesce(1).write.text(path)
    return D.read_seeds(spark, path)


@R.add("SELECT max(export_ts)::BIGINT AS last_timestamp FROM follows")
def marker(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "marker") + "/marker.json"
    D.write_marker(path, int(table(spark, d, "follows").agg(F.max("export_ts")).first()[0]))
    return spark.createDataFrame([(D.read_marker(path),)], "last_timestamp bigint")


_STREAM = """WITH e AS (SELECT DISTINCT fid, id, timestamp FROM casts WHERE fid IS NOT NULL AND timestamp IS NOT NULL),
g AS (SELECT fid, epoch_us(timestamp) AS t, lag(epoch_us(timestamp)) OVER (PARTITION BY fid ORDER BY timestamp) AS p FROM e),
s AS (SELECT fid, t, sum(CASE WHEN p IS NULL OR t - p > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT fid, min(t) AS start_us, max(t) AS end_us, count(*) AS n_events FROM s GROUP BY fid, s"""


@R.add(_STREAM)
def p2_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of casts from a stream in two batches, by odd and even id, so that the second is late throughout.

    The watermark waits 90 days, longer than the table lasts; an event after the end of all time closes the rest.
    """
    src, out = _path(spark, "stream"), _path(spark, "sessions")
    e = records(table(spark, d, "casts", ["id", "fid", "timestamp"]).where("fid IS NOT NULL AND timestamp IS NOT NULL"), "id", ["fid", "timestamp"])
    e.where("id % 2 = 1").write.parquet(f"{src}/1")
    end = spark.createDataFrame([(-1, -1, "2200-01-01 00:00:00")], "id bigint, fid bigint, t string").select("id", "fid", F.col("t").cast("timestamp_ntz").alias("timestamp"))
    e.where("id % 2 <> 1").unionAll(end).write.parquet(f"{src}/2")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = stream_sessions(s, "fid", "timestamp", 1800, "90 days").writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}-cp").trigger(availableNow=True).start(out)
    q.awaitTermination()
    r = spark.read.parquet(out)
    return r.select("fid", micros(F.col("start").cast("timestamp_ntz")).alias("start_us"), micros(F.col("end").cast("timestamp_ntz")).alias("end_us"), "n_events")


@R.add(_sql("SELECT fid FROM sc WHERE casts = 0 AND reacts > 0"))
def infinite_rows(spark: SparkSession, d: str) -> DataFrame:
    """Accounts whose ratio of reactions to casts is infinite."""
    s = _scores(spark, d)
    return P.bad_rows(s.withColumn("ratio", sdiv("reacts", "casts", compat=True)), "fid")


@R.add(_sql("SELECT count(*) AS n FROM sc JOIN lb USING (fid) WHERE p1 IS NOT NULL AND bot IS NOT NULL"))
def checked_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores and labels that pass validation: complete, binary, within [0, 1], no negative number."""
    x = _scores(spark, d).join(V.labels(spark, d).where("bot IS NOT NULL"), "fid").where("p1 IS NOT NULL").select("p1", F.col("bot").cast("int").alias("bot"))
    return P.check_non_negative(M.checked(x, "p1", "bot")).agg(F.count(F.lit(1)).alias("n"))


@R.add(_sql("SELECT count(*) AS n, count(*) FILTER (p1 >= 0.5) AS n_above, count(*) FILTER (p1 < 0.5) AS n_below, round(avg(p1), 6) AS mean, round(stddev_samp(p1), 6) AS std, min(p1) AS min, max(p1) AS max FROM sc WHERE p1 IS NOT NULL"))
def population(spark: SparkSession, d: str) -> DataFrame:
    """Make-up of all scores; the median, an approximate order statistic, is compared in the tests."""
    return S.population(_scores(spark, d), "p1").drop("median").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@R.add("SELECT o_orderkey, o_orderkey::DOUBLE * 10000000000000 / 1e18 AS amount FROM orders")
def hex_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Hexadecimal amounts of a currency with 18 decimals; the whole numbers pass the range of bigint from key 922,338 on."""
    o, k = table(spark, d, "orders", ["o_orderkey"]), F.col("o_orderkey").cast("decimal(19,0)")
    amount = hex_amount(hex_whole(F.abs(k) * F.lit(Decimal(10_000_000_000_000))))
    return o.select("o_orderkey", F.when(k < 0, -amount).otherwise(amount).alias("amount"))


@R.add(V.with_views("lb", "SELECT fid, CASE WHEN fid IN (SELECT fid FROM lb WHERE bot) THEN 1 WHEN fid IN (SELECT fid FROM lb WHERE NOT bot) THEN 0 END AS label FROM (SELECT DISTINCT fid FROM signers WHERE fid IS NOT NULL)"))
def attached_labels(spark: SparkSession, d: str) -> DataFrame:
    lb = V.labels(spark, d)
    return attach(V.signers(spark, d).select("fid").distinct(), lb.where("bot"), lb.where("NOT bot")).select("fid", "label")


QUERIES, ORACLE = R.queries, R.oracle
