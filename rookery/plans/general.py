"""Queries for the general data-processing problems, each over its whole tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.timex import micros
from rookery.operators.cumulative import NO_DAY, cumulative_store, feature_table, period_features, type_features
from rookery.operators.eager import KeyedInput, eager_states, heavy_keys, join_totals
from rookery.operators.intervals import lifetime_runs, orphans
from rookery.operators.rolling import daily_totals, rolling_totals
from rookery.operators.sessions import sessionize
from rookery.operators.snapshots import snapshot_changes
from rookery.sources.tables import activity, records, table

SESSION_GAP_SECONDS = 1800
HEAVY_PERCENT = 3
#: the last day that a timestamp can name, in days since 1970-01-01
LAST_DAY = 2_932_896

_KEYS = {"casts": "casts.fid", "reactions": "reactions.fid", "follows": "follows.target_fid"}


def _p1_inputs(spark: SparkSession, d: str, names: dict[str, str]) -> list[KeyedInput]:
    return [KeyedInput(table(spark, d, t, [k.split(".")[1]]), names[t], k.split(".")[1]) for t, k in _KEYS.items()]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least 3 % of all rows of their table."""
    return heavy_keys(_p1_inputs(spark, d, _KEYS), HEAVY_PERCENT).select("key_field", F.col("key").alias("fid"))


def p1_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Per account: rows in each table and the rows that casts x reactions of the account would give, as exact decimal digits."""
    s = eager_states(_p1_inputs(spark, d, {t: t for t in _KEYS}))
    pairs = join_totals(s, "casts", "reactions").withColumnRenamed("key", "fid")
    return (
        s.where("key IS NOT NULL")
        .withColumnRenamed("key", "fid")
        .join(pairs, "fid", "left")
        .select("fid", "casts_rows", "reactions_rows", "follows_rows", F.coalesce(F.col("pairs").cast("string"), F.lit("0")).alias("cast_reaction_pairs"))
    )


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    events = activity(table(spark, d, "casts", ["id", "fid", "timestamp"]), table(spark, d, "reactions", ["id", "fid", "timestamp"]))
    return sessionize(events, "fid", "timestamp", SESSION_GAP_SECONDS, record=["kind", "id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every session's account, first and last event."""
    return _sessions(spark, d).select("fid", "start_us", "end_us")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every session with its duration and number of records."""
    return _sessions(spark, d)


def feature_events(spark: SparkSession, d: str) -> DataFrame:
    """(fid, event_type, timestamp, amount): the records of casts and reactions and the distinct follows."""
    c = table(spark, d, "casts", ["id", "fid", "timestamp", "parent_hash", "parent_url", "text"]).where("fid IS NOT NULL")
    kind = F.when(F.col("parent_hash").isNotNull(), "reply").when(F.col("parent_url").isNotNull(), F.concat(F.lit("cast:"), "parent_url")).otherwise("cast")
    c = c.select("id", "fid", kind.alias("event_type"), "timestamp", F.coalesce(F.char_length("text"), F.lit(0)).alias("amount"))
    r = table(spark, d, "reactions", ["id", "fid", "reaction_type", "timestamp"]).where("fid IS NOT NULL AND reaction_type IS NOT NULL")
    r = records(r, "id", ["fid", "reaction_type", "timestamp"])
    f = table(spark, d, "follows", ["fid", "target_fid", "timestamp"]).where("fid IS NOT NULL AND target_fid IS NOT NULL")
    f = f.groupBy("fid", "target_fid").agg(F.max("timestamp").alias("timestamp"))
    return (
        records(c, "id", ["fid", "event_type", "timestamp", "amount"])
        .select("fid", "event_type", "timestamp", "amount")
        .unionAll(r.select("fid", F.concat(F.lit("reaction:"), F.col("reaction_type").cast("string")), "timestamp", F.lit(1)))
        .unionAll(f.select("target_fid", F.lit("followed"), "timestamp", F.lit(1)))
    )


def _store(spark: SparkSession, d: str) -> DataFrame:
    return cumulative_store(feature_events(spark, d), "fid", "event_type", "timestamp", "amount")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Accounts and kinds with at least 3 events in the period from the undated events to the last day there is."""
    events = period_features(_store(spark, d), F.lit(NO_DAY), F.lit(LAST_DAY))
    return events.where("n >= 3").select(F.col("entity").alias("fid"), "event_type")


def p3_type_features(spark: SparkSession, d: str) -> DataFrame:
    """Count, total, latest time and 7- and 30-day windows of each account and kind as of the end of 2024."""
    end = F.unix_date(F.lit("2024-12-31").cast("date"))
    t = type_features(_store(spark, d), end, {"7d": 7, "30d": 30})
    return t.select(F.col("entity").alias("fid"), "event_type", "n", "total", micros("last_ts").alias("last_us"), "n_7d", "total_7d", "n_30d", "total_30d")


def p3_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per account: totals, and its kinds of event in order with count, total and latest time, as text."""
    t = feature_table(type_features(_store(spark, d)).withColumn("last_us", F.coalesce(micros("last_ts").cast("string"), F.lit(""))), "fid")
    cell = lambda x: F.concat_ws("|", x["event_type"], x["n"].cast("string"), x["total"].cast("string"), x["last_us"])
    return t.select("fid", "n_types", "n_events", "total", micros("last_ts").alias("last_us"), F.array_join(F.transform("types", cell), "\n").alias("types"))


_SNAPSHOTS = {
    "profile_with_addresses": (["fid"], ["fname", "bio", "avatar_url", "verified_addresses", "display_name"]),
    "follow_counts": (["fid"], ["follower_count", "following_count"]),
    "follows": (["fid", "target_fid"], ["timestamp", "created_at", "deleted_at"]),
}


def _changes(spark: SparkSession, d: str) -> DataFrame:
    out: DataFrame | None = None
    for name, (keys, fields) in _SNAPSHOTS.items():
        c = snapshot_changes(table(spark, d, name), keys, fields, "export_ts")
        key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
        c = c.select(F.lit(name).alias("table_name"), key.alias("row_key"), "export_ts", "change_kind", "changed_fields")
        out = c if out is None else out.unionAll(c)
    assert out is not None
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that are new, gone or different in consecutive exports."""
    return _changes(spark, d).drop("changed_fields")


def p4_changed_fields(spark: SparkSession, d: str) -> DataFrame:
    """How often each field changed, per table and export."""
    c = _changes(spark, d).where("change_kind = 'changed'")
    return c.select("table_name", "export_ts", F.explode("changed_fields").alias("field")).groupBy("table_name", "export_ts", "field").agg(F.count(F.lit(1)).alias("n_rows"))


_WINDOWS = {"n7": (-6, 0), "n30": (-29, 0)}


def _daily(spark: SparkSession, d: str) -> DataFrame:
    events = activity(table(spark, d, "casts", ["id", "fid", "timestamp"]), table(spark, d, "reactions", ["id", "fid", "timestamp"]))
    return daily_totals(events.distinct(), "fid", "timestamp")


def p6_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Totals and daily averages of the last 7 and 30 days for every account and day up to 29 days after its last event."""
    r = rolling_totals(_daily(spark, d), "fid", _WINDOWS, tail_days=29)
    return r.select(
        "fid", F.date_format("day", "yyyy-MM-dd").alias("cal_day"), "n", "n7", "n30", F.round(F.col("n7") / 7.0, 6).alias("avg7"), F.round(F.col("n30") / 30.0, 6).alias("avg30")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Quiet days amid activity that is falling: none today, at least 5 in 7 days, a lower average than in 30 days, more to come."""
    r = rolling_totals(_daily(spark, d), "fid", {**_WINDOWS, "ahead": (1, 30)})
    return r.where("n = 0 AND ahead > 0 AND n7 >= 5 AND n7 * 30 < n30 * 7").select("fid", F.date_format("day", "yyyy-MM-dd").alias("cal_day"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References to accounts and to casts: (ref_field, row_key, k, t)."""
    c = table(spark, d, "casts", ["id", "timestamp", "parent_fid", "parent_hash"])
    r = table(spark, d, "reactions", ["id", "timestamp", "target_fid"])
    f = table(spark, d, "follows", ["fid", "target_fid", "timestamp"]).distinct()
    ref = lambda df, field, key, row: df.select(F.lit(field).alias("ref_field"), row.alias("row_key"), F.col(key).alias("k"), micros("timestamp").alias("t"))
    own = F.col("id").cast("string")
    accounts = (
        ref(r, "reactions.target_fid", "target_fid", own)
        .unionAll(ref(f, "follows.target_fid", "target_fid", F.concat(F.coalesce(F.col("fid").cast("string"), F.lit("")), F.lit(":"), F.col("target_fid").cast("string"))))
        .unionAll(ref(c, "casts.parent_fid", "parent_fid", own))
    )
    return accounts, ref(c, "casts.parent_hash", "parent_hash", own)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    accounts, casts = _references(spark, d)
    s = table(spark, d, "signers", ["fid", "timestamp", "deleted_at"]).select("fid", micros("timestamp").alias("s"), micros("deleted_at").alias("e"))
    h = table(spark, d, "casts", ["hash", "timestamp", "deleted_at"]).select("hash", micros("timestamp").alias("s"), micros("deleted_at").alias("e"))
    a = orphans(accounts, lifetime_runs(s, "fid", "s", "e"), "k", "t", integer_keys=True)
    b = orphans(casts, lifetime_runs(h, "hash", "s", "e"), "k", "t")
    cols = ("ref_field", "row_key", "t", "orphan_kind")
    return a.select(*cols).unionAll(b.select(*cols))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose target does not exist at the record's time."""
    return _orphans(spark, d).select("ref_field", "row_key").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, month and kind."""
    period = F.date_format(F.date_from_unix_date(F.expr("CAST(floor(t / 86400000000) AS INT)")), "yyyy-MM")
    return (
        _orphans(spark, d)
        .distinct()
        .groupBy(F.substring_index("ref_field", ".", 1).alias("table_name"), "ref_field", period.alias("period"), "orphan_kind")
        .agg(F.count(F.lit(1)).alias("n_refs"))
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_accounts, p2_found, p2_sessions, p3_found, p3_type_features, p3_features, p4_found, p4_changed_fields, p6_found, p6_rolling, p7_found, p7_report)}

_HEAVY = "\nUNION ALL ".join(
    f"SELECT '{label}' AS key_field, {label.split('.')[1]} AS fid FROM {t} WHERE {label.split('.')[1]} IS NOT NULL "
    f"GROUP BY 2 HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM {t})"
    for t, label in _KEYS.items()
)

_EVENTS = """SELECT DISTINCT fid, kind, id, timestamp FROM (
  SELECT fid, 1 AS kind, id, timestamp FROM casts UNION ALL SELECT fid, 2, id, timestamp FROM reactions)
WHERE fid IS NOT NULL AND timestamp IS NOT NULL"""

_SESSIONS = f"""WITH e AS ({_EVENTS}),
g AS (SELECT fid, epoch_us(timestamp) AS t, lag(epoch_us(timestamp)) OVER (PARTITION BY fid ORDER BY timestamp) AS p FROM e),
s AS (SELECT fid, t, sum(CASE WHEN p IS NULL OR t - p > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g),
x AS (SELECT fid, min(t) AS start_us, max(t) AS end_us, max(t) - min(t) AS duration_us, count(*) AS n_events FROM s GROUP BY fid, s)
"""

_TYPES = """WITH ev AS (
  SELECT fid, event_type, timestamp, amount FROM (SELECT DISTINCT id, fid, timestamp, coalesce(length(text), 0) AS amount,
    CASE WHEN parent_hash IS NOT NULL THEN 'reply' WHEN parent_url IS NOT NULL THEN 'cast:' || parent_url ELSE 'cast' END AS event_type FROM casts WHERE fid IS NOT NULL)
  UNION ALL SELECT fid, 'reaction:' || reaction_type, timestamp, 1 FROM (SELECT DISTINCT id, fid, reaction_type, timestamp FROM reactions WHERE fid IS NOT NULL AND reaction_type IS NOT NULL)
  UNION ALL SELECT target_fid, 'followed', max(timestamp), 1 FROM follows WHERE fid IS NOT NULL AND target_fid IS NOT NULL GROUP BY fid, target_fid)
"""

_DAILY = f"""d AS (SELECT fid, CAST(timestamp AS DATE) AS day, count(*) AS n FROM ({_EVENTS}) GROUP BY 1, 2),
cal AS (SELECT fid, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP) + INTERVAL (TAIL) DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY fid),
r AS (SELECT c.fid, c.day, coalesce(sum(d.n) FILTER (d.day = c.day), 0) AS n, coalesce(sum(d.n) FILTER (d.day BETWEEN c.day - 6 AND c.day), 0) AS n7,
  coalesce(sum(d.n) FILTER (d.day BETWEEN c.day - 29 AND c.day), 0) AS n30, coalesce(sum(d.n) FILTER (d.day > c.day), 0) AS ahead
  FROM cal c LEFT JOIN d ON d.fid = c.fid AND d.day BETWEEN c.day - 29 AND c.day + 30 GROUP BY 1, 2)
"""


def _diff_sql(t: str, key: str, by: str, fields: list[str]) -> str:
    cells = ", ".join(fields)
    return f"""SELECT '{t}' AS table_name, CASE WHEN a.fid IS NULL THEN {key.replace("#", "b")} ELSE {key.replace("#", "a")} END AS row_key, p.later AS export_ts,
  CASE WHEN a.fid IS NULL THEN 'added' WHEN b.fid IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT x AS earlier, lead(x) OVER (ORDER BY x) AS later FROM (SELECT DISTINCT export_ts AS x FROM {t})) p
JOIN LATERAL (SELECT 1) ON p.later IS NOT NULL
JOIN (SELECT DISTINCT export_ts AS at, {by} FROM {t}) k ON k.at IN (p.earlier, p.later)
LEFT JOIN (SELECT DISTINCT export_ts, {by}, {cells} FROM {t}) a ON a.export_ts = p.earlier AND {" AND ".join(f"a.{c.strip()} = k.{c.strip()}" for c in by.split(","))}
LEFT JOIN (SELECT DISTINCT export_ts, {by}, {cells} FROM {t}) b ON b.export_ts = p.later AND {" AND ".join(f"b.{c.strip()} = k.{c.strip()}" for c in by.split(","))}
WHERE a.fid IS NULL OR b.fid IS NULL OR {" OR ".join(f"a.{f} IS DISTINCT FROM b.{f}" for f in fields)}
GROUP BY ALL"""


_CHANGES = "\nUNION ALL ".join(
    _diff_sql(t, "CAST(#.fid AS VARCHAR)" + (" || ':' || CAST(#.target_fid AS VARCHAR)" if len(k) > 1 else ""), ", ".join(k), f) for t, (k, f) in _SNAPSHOTS.items()
)

_FIELDS = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, b.export_ts, '{f}' AS field, count(*) AS n_rows FROM (SELECT DISTINCT export_ts, {', '.join(k)}, {', '.join(fs)} FROM {t}) b"
    f" JOIN (SELECT DISTINCT export_ts, {', '.join(k)}, {', '.join(fs)} FROM {t}) a ON {' AND '.join(f'a.{c} = b.{c}' for c in k)}"
    f" AND a.export_ts = (SELECT max(export_ts) FROM {t} z WHERE z.export_ts < b.export_ts) WHERE a.{f} IS DISTINCT FROM b.{f} GROUP BY ALL"
    for t, (k, fs) in _SNAPSHOTS.items()
    for f in fs
)

_REFS = """WITH refs AS (
  SELECT DISTINCT 'reactions.target_fid' AS ref_field, CAST(id AS VARCHAR) AS row_key, target_fid AS k, timestamp AS t FROM reactions WHERE target_fid IS NOT NULL AND timestamp IS NOT NULL
  UNION SELECT 'follows.target_fid', coalesce(CAST(fid AS VARCHAR), '') || ':' || CAST(target_fid AS VARCHAR), target_fid, timestamp FROM follows WHERE target_fid IS NOT NULL AND timestamp IS NOT NULL
  UNION SELECT 'casts.parent_fid', CAST(id AS VARCHAR), parent_fid, timestamp FROM casts WHERE parent_fid IS NOT NULL AND timestamp IS NOT NULL),
hrefs AS (SELECT DISTINCT 'casts.parent_hash' AS ref_field, CAST(id AS VARCHAR) AS row_key, parent_hash AS k, timestamp AS t FROM casts WHERE parent_hash IS NOT NULL AND timestamp IS NOT NULL),
o AS (SELECT ref_field, row_key, t, CASE WHEN NOT EXISTS (SELECT 1 FROM signers s WHERE s.fid = k AND s.timestamp IS NOT NULL AND (s.deleted_at IS NULL OR s.deleted_at > s.timestamp)) THEN 'never'
    WHEN EXISTS (SELECT 1 FROM signers s WHERE s.fid = k AND s.timestamp <= t AND (s.deleted_at IS NULL OR s.deleted_at > s.timestamp)) THEN 'gone' ELSE 'later' END AS orphan_kind FROM refs
  WHERE NOT EXISTS (SELECT 1 FROM signers s WHERE s.fid = k AND s.timestamp <= t AND (s.deleted_at IS NULL OR s.deleted_at > t))
  UNION ALL SELECT ref_field, row_key, t, CASE WHEN NOT EXISTS (SELECT 1 FROM casts s WHERE s.hash = k AND s.timestamp IS NOT NULL AND (s.deleted_at IS NULL OR s.deleted_at > s.timestamp)) THEN 'never'
    WHEN EXISTS (SELECT 1 FROM casts s WHERE s.hash = k AND s.timestamp <= t AND (s.deleted_at IS NULL OR s.deleted_at > s.timestamp)) THEN 'gone' ELSE 'later' END FROM hrefs
  WHERE NOT EXISTS (SELECT 1 FROM casts s WHERE s.hash = k AND s.timestamp <= t AND (s.deleted_at IS NULL OR s.deleted_at > t)))
"""

_SUM = lambda c, days: f"coalesce(sum({c}) FILTER (CAST(timestamp AS DATE) > DATE '2024-12-31' - {days} AND CAST(timestamp AS DATE) <= DATE '2024-12-31'), 0)::BIGINT"

ORACLE = {
    "p1_found": _HEAVY,
    "p1_accounts": """WITH k AS (SELECT fid FROM casts UNION SELECT fid FROM reactions UNION SELECT target_fid FROM follows),
c AS (SELECT fid, count(*) AS n FROM casts GROUP BY 1), r AS (SELECT fid, count(*) AS n FROM reactions GROUP BY 1), f AS (SELECT target_fid AS fid, count(*) AS n FROM follows GROUP BY 1)
SELECT k.fid, coalesce(c.n, 0) AS casts_rows, coalesce(r.n, 0) AS reactions_rows, coalesce(f.n, 0) AS follows_rows, coalesce(CAST(c.n::HUGEINT * r.n AS VARCHAR), '0') AS cast_reaction_pairs
FROM k LEFT JOIN c USING (fid) LEFT JOIN r USING (fid) LEFT JOIN f USING (fid) WHERE k.fid IS NOT NULL""",
    "p2_found": _SESSIONS + "SELECT fid, start_us, end_us FROM x",
    "p2_sessions": _SESSIONS + "SELECT fid, start_us, end_us, duration_us, n_events FROM x",
    "p3_found": _TYPES + "SELECT fid, event_type FROM ev GROUP BY 1, 2 HAVING count(*) >= 3",
    "p3_type_features": _TYPES
    + f"""SELECT fid, event_type, count(*) AS n, sum(amount)::BIGINT AS total, epoch_us(max(timestamp)) AS last_us, {_SUM("1", 7)} AS n_7d, {_SUM("amount", 7)} AS total_7d, {_SUM("1", 30)} AS n_30d, {_SUM("amount", 30)} AS total_30d
FROM ev WHERE timestamp IS NULL OR CAST(timestamp AS DATE) <= DATE '2024-12-31' GROUP BY 1, 2""",
    "p3_features": _TYPES
    + """SELECT fid, count(*) AS n_types, sum(n)::BIGINT AS n_events, sum(total)::BIGINT AS total, max(last_us) AS last_us,
string_agg(concat_ws('|', event_type, n::VARCHAR, total::VARCHAR, coalesce(last_us::VARCHAR, '')), chr(10) ORDER BY event_type) AS types
FROM (SELECT fid, event_type, count(*) AS n, sum(amount)::BIGINT AS total, epoch_us(max(timestamp)) AS last_us FROM ev GROUP BY 1, 2) GROUP BY fid""",
    "p4_found": _CHANGES,
    "p4_changed_fields": _FIELDS,
    "p6_found": "WITH " + _DAILY.replace("TAIL", "0") + "SELECT fid, strftime(day, '%Y-%m-%d') AS cal_day FROM r WHERE n = 0 AND ahead > 0 AND n7 >= 5 AND n7 * 30 < n30 * 7",
    "p6_rolling": "WITH "
    + _DAILY.replace("TAIL", "29")
    + "SELECT fid, strftime(day, '%Y-%m-%d') AS cal_day, n::BIGINT AS n, n7::BIGINT AS n7, n30::BIGINT AS n30, round(n7 / 7.0, 6) AS avg7, round(n30 / 30.0, 6) AS avg30 FROM r",
    "p7_found": _REFS + "SELECT DISTINCT ref_field, row_key FROM o",
    "p7_report": _REFS + "SELECT split_part(ref_field, '.', 1) AS table_name, ref_field, strftime(t, '%Y-%m') AS period, orphan_kind, count(*) AS n_refs FROM o GROUP BY ALL",
}
