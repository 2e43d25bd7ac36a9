"""Operators of the general problems on small tables: nulls, ties, repeats, empty tables, clashing names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rookery.features.gaps import with_gaps, with_running_count
from rookery.functions.timex import micros
from rookery.operators.cumulative import NO_DAY, cumulative_store, feature_table, period_features, type_features, wide_features
from rookery.operators.eager import KeyedInput, eager_states, heavy_keys, join_totals
from rookery.operators import intervals, skew
from rookery.operators.intervals import key_runs, lifetime_runs, orphans, with_known
from rookery.operators.rolling import daily_totals, rolling_totals
from rookery.operators.sessions import sessionize
from rookery.operators.skew import hot_groups, time_chunks, with_parts
from rookery.operators.snapshots import snapshot_changes
from rookery.streaming.sessions import stream_counts, stream_sessions

T0 = dt.datetime(2024, 1, 1)


def at(seconds, us=0):
    return T0 + dt.timedelta(seconds=seconds, microseconds=us)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# 1. keys that hold most rows


def test_states_of_missing_and_null_keys(spark):
    a = spark.createDataFrame([(1, 5), (1, None), (None, 2), (2, 1)], "key int, v int")
    b = spark.createDataFrame([(1, 7), (3, 1), (None, 9), (None, 9)], "k int, v int")
    s = eager_states([KeyedInput(a, "a", "key", ["v"]), KeyedInput(b, "b", "k", ["v"])])
    got = {(r["key"], r["a_rows"], r["b_rows"], r["a_v_sum"], r["b_v_sum"]) for r in s.collect()}
    assert got == {(1, 2, 1, 5, 7), (2, 1, 0, 1, None), (3, 0, 1, None, 1), (None, 1, 0, 2, None), (None, 0, 2, None, 18)}


def test_join_totals_equal_the_join(spark):
    rng = random.Random(1)
    a = spark.createDataFrame([(rng.choice([0, 0, 0, 1, 2, None]), rng.randrange(9)) for _ in range(200)], "k int, x int")
    b = spark.createDataFrame([(rng.choice([0, 0, 2, 3, None]), rng.randrange(9)) for _ in range(100)], "k int, y int")
    s = eager_states([KeyedInput(a, "a", "k", ["x"]), KeyedInput(b, "b", "k", ["y"])])
    got = {(r["key"], int(r["pairs"]), int(r["a_x_joined"]), int(r["b_y_joined"])) for r in join_totals(s, "a", "b", ["x"], ["y"]).collect()}
    want = {tuple(r) for r in a.join(b, "k").groupBy("k").agg(F.count(F.lit(1)), F.sum("x"), F.sum("y")).collect()}
    assert got == want


def test_heavy_keys_count_null_rows_in_the_total(spark):
    a = spark.createDataFrame([(1,)] * 3 + [(2,)] * 2 + [(None,)] * 95, "fid int")
    assert rows(heavy_keys([KeyedInput(a, "a.fid", "fid")], 3)) == [("a.fid", 1, 3, 100)]
    assert rows(heavy_keys([KeyedInput(a.limit(0), "a.fid", "fid")], 3)) == []


def test_products_of_busy_keys_do_not_overflow(spark):
    s = spark.createDataFrame([(1, 4_000_000_000, 5_000_000_000, 10**12)], "key int, a_rows bigint, b_rows bigint, a_x_sum bigint")
    s = s.withColumn("a_x_sum", F.col("a_x_sum").cast("decimal(38,0)"))
    got = join_totals(s, "a", "b", ["x"]).first()
    assert (got["pairs"], got["a_x_joined"]) == (20 * 10**18, 5 * 10**21)
    big = spark.createDataFrame([(1, 2**62)] * 4, "k int, x bigint")
    assert eager_states([KeyedInput(big, "a", "k", ["x"])]).first()["a_x_sum"] == 2**64


# 2. sessions


def brute_sessions(events, gap_us):
    out = {}
    for k, t in sorted({(k, t) for k, t in events}):
        s = out.setdefault(k, [])
        if s and t - s[-1][1] <= gap_us:
            s[-1][1] = t
        else:
            s.append([t, t])
    return sorted((k, a, b) for k, v in out.items() for a, b in v)


def test_session_borders_and_repeats(spark):
    e = [(1, at(0), 1), (1, at(1800), 2), (1, at(3600, 1), 3), (1, at(0), 1), (2, at(5), 9), (None, at(6), 4), (2, None, 5), (2, at(5), 10)]
    df = spark.createDataFrame(e, "k int, s timestamp_ntz, id int").withColumns({"c": F.lit(1), "e": F.lit("x"), "w": F.lit(2)})
    got = [(r["k"], r["duration_us"], r["n_events"]) for r in sessionize(df, "k", "s", 1800, ["id"]).orderBy("k", "start_us").collect()]
    assert got == [(1, 1_800_000_000, 2), (1, 0, 1), (2, 0, 2)]
    assert sessionize(df.limit(0), "k", "s", 1800, ["id"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_sessions_match_brute_force_whatever_the_chunk(spark, seed):
    rng = random.Random(seed)
    e = [(rng.choice([1, 1, 1, 2, 3]), at(rng.randrange(-200_000, 400_000), rng.randrange(2))) for _ in range(400)]
    df = spark.createDataFrame(e, "fid int, t timestamp_ntz")
    us = [(k, int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))) for k, t in e]
    want = brute_sessions(us, 1_800_000_000)
    for chunk in (3600, 86_400):
        assert rows(sessionize(df, "fid", "t", 1800, chunk_seconds=chunk).select("fid", "start_us", "end_us")) == sorted(want, key=str)


def test_hot_chunks_of_sessions_are_divided(spark):
    # one account with a third of all events, most of them in one second
    rng = random.Random(9)
    e = [(7, at(50_000, rng.randrange(10**6)), i) for i in range(900)] + [(7, at(rng.randrange(90_000)), i) for i in range(900, 1000)]
    e += [(rng.randrange(10, 400), at(rng.randrange(90_000)), i) for i in range(1000, 3000)]
    e += e[::7]
    df = spark.createDataFrame(e, "fid int, t timestamp_ntz, id int")
    plain, cut = (rows(sessionize(df, "fid", "t", 600, ["id"], rows_per_task=n)) for n in (10**9, 50))
    assert plain == cut and sum(r[4] for r in cut) == 3000
    parts = with_parts(df, ["fid"], hot_groups(df, ["fid"], 50)).groupBy("fid").agg(F.max("parts__").alias("p")).where("p > 1").collect()
    assert [(r["fid"], r["p"]) for r in parts] == [(7, -(-sum(x[0] == 7 for x in e) // 50))]
    assert hot_groups(df.limit(0), ["fid"], 50).count() == 0


def test_chunks_of_time_are_balanced_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(skew, "fits_one_task", lambda df: False)
    rng = random.Random(3)
    e = [(1, at(rng.choice([5, rng.randrange(80_000)]))) for _ in range(2000)] + [(2, at(9)), (1, None), (None, at(3))]
    x = time_chunks(spark.createDataFrame(e, "fid int, t timestamp_ntz"), "fid", "t", rows_per_task=200)
    got = sorted(((r["span__"], r["part__"]), r["t"]) for r in x.where("fid = 1 AND t IS NOT NULL").collect())
    assert len(got) == 2000 and [t for _, t in got] == sorted(t for _, t in got)  # chunks do not interleave
    sizes = sorted(r["count"] for r in x.where("fid = 1").groupBy(*skew.CHUNK).count().collect())
    assert sizes[-1] <= 1400 and max(sizes[:-1]) <= 210 and x.count() == len(e)


def test_small_inputs_are_not_counted_first(spark):
    assert skew.fits_one_task(spark.range(1000)) and not skew.fits_one_task(spark.range(10_000_000))
    df = spark.createDataFrame([(1, at(3))], "fid int, t timestamp_ntz")
    assert time_chunks(df, "fid", "t", rows_per_task=0).first()["part__"] == 0


def test_gaps_do_not_depend_on_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(skew, "fits_one_task", lambda df: False)
    rng = random.Random(4)
    e = [(rng.choice([1, 1, 1, 2, 3]), i, at(rng.choice([77, rng.randrange(10**7)]))) for i in range(600)]
    df = spark.createDataFrame(e, "fid int, id int, ts timestamp_ntz").withColumns({"rows__": F.lit(1), "n": F.lit(1)})
    a, b = (rows(with_gaps(df, "fid", "ts", "id", rows_per_task=n).select("fid", "id", "prev_ts", "gap_s")) for n in (10**9, 20))
    assert a == b and len(a) == 600
    a, b = (rows(with_running_count(df, "fid", "ts", "id", "id", "c", rows_per_task=n).select("fid", "id", "c")) for n in (10**9, 20))
    assert a == b and len(a) == 600


def test_stream_sessions_take_late_events(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "fid int, ts timestamp_ntz"
    batches = [[(1, at(0)), (1, at(100))], [(1, at(9000)), (1, at(1500))], [(1, at(60_000)), (2, None)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(src / f"b{i}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = stream_sessions(s, "fid", "ts", 1800, "2 hours").writeStream.outputMode("append").format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r["fid"], int((r["end"] - r["start"]).total_seconds()), r["n_events"]) for r in spark.table("sess").orderBy("start").collect()]
    assert got == [(1, 1500, 3), (1, 0, 1)]


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([(1, at(10)), (1, at(20)), (1, at(400))], "fid int, ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("fid int, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    q = stream_counts(s, ["fid"], "ts", "5 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("cnt").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("cnt").collect()) == [1, 2]


# 3. feature table


def test_windows_by_subtraction(spark):
    day = lambda n: at(86_400 * n)
    e = [(1, "a", day(0), 5), (1, "a", day(0), None), (1, "a", day(3), 2), (1, "b", None, 4), (1, "a", day(9), 1), (None, "a", day(1), 1), (2, None, day(1), 1)]
    df = spark.createDataFrame(e, "fid int, kind string, ts timestamp_ntz, amount int").withColumns({"entity": F.lit(9), "n": F.lit(9), "day": F.lit(9)})
    store = cumulative_store(df, "fid", "kind", "ts", "amount")
    end = F.unix_date(F.lit("2024-01-08").cast("date"))
    t = {(r["entity"], r["event_type"]): r for r in type_features(store, end, {"7d": 7, "5d": 5}).collect()}
    assert set(t) == {(1, "a"), (1, "b")}
    a, b = t[1, "a"], t[1, "b"]
    assert (a["n"], a["total"], a["n_7d"], a["n_5d"], a["last_ts"]) == (3, 7, 1, 1, day(3))
    assert (b["n"], b["total"], b["n_7d"], b["last_ts"]) == (1, 4, 0, None)
    p = {(r["entity"], r["event_type"]): (r["n"], r["total"], r["last_ts"]) for r in period_features(store, end - 6, end).collect()}
    assert p == {(1, "a"): (1, 2, day(3))}
    p = {(r["entity"], r["event_type"]): r["n"] for r in period_features(store, F.lit(NO_DAY), end).collect()}
    assert p == {(1, "a"): 3, (1, "b"): 1}
    with pytest.raises(Exception, match="more than 1 event types"):
        feature_table(type_features(store), "fid", max_types=1).collect()
    one = feature_table(type_features(store), "fid").collect()
    assert len(one) == 1 and one[0]["n_events"] == 5 and [x["event_type"] for x in one[0]["types"]] == ["a", "b"]
    wide = wide_features(type_features(store), "fid", ["a", "b", "c"]).collect()[0]
    assert (wide["n__0"], wide["n__1"], wide["n__2"], wide["last_ts__2"]) == (4, 1, 0, None)
    assert type_features(cumulative_store(df.limit(0), "fid", "kind", "ts")).count() == 0


# 4. snapshots


def test_changes_between_snapshots(spark):
    d = [(1, "a", None, 10), (1, "a", None, 10), (2, "x", 1, 10), (3, "q", 1, 10), (1, "a", None, 20), (2, "", 1, 20), (4, None, None, 20), (None, "z", 1, 20), (1, "a", 0, 30), (2, "", 1, 30), (5, "v", 1, None)]
    df = spark.createDataFrame(d, "fid int, name string, n int, export_ts bigint").withColumns({"k0": F.lit("c"), "f0": F.lit("c"), "at": F.lit(1), "sign": F.lit(1), "pair": F.lit(1)})
    got = rows(snapshot_changes(df, ["fid"], ["name", "n"], "export_ts"))
    assert got == sorted([(2, 20, "changed", ["name"]), (3, 20, "removed", None), (4, 20, "added", None), (1, 30, "changed", ["n"]), (4, 30, "removed", None)], key=str)
    assert snapshot_changes(df.limit(0), ["fid"], ["name"], "export_ts").count() == 0
    assert snapshot_changes(df.where("export_ts = 10"), ["fid"], ["name"], "export_ts").count() == 0


def test_rows_that_disagree_inside_a_snapshot(spark):
    d = [(1, "a", 1), (1, "b", 1), (1, "b", 2), (2, "a", 1), (2, "b", 1), (2, "a", 2), (2, "b", 2)]
    got = rows(snapshot_changes(spark.createDataFrame(d, "k int, v string, s bigint"), ["k"], ["v"], "s"))
    assert got == [(1, 2, "changed", ["v"])]


# 6. rolling totals


def test_rolling_matches_brute_force(spark):
    rng = random.Random(5)
    e = [(rng.choice([1, 1, 1, 2]), at(86_400 * rng.randrange(80))) for _ in range(60)] + [(None, at(0)), (3, None), (4, at(7))]
    df = spark.createDataFrame(e, "fid int, t timestamp_ntz").withColumns({"e": F.lit(1), "n": F.lit(1), "day": F.lit(1), "b": F.lit(1)})
    r = rolling_totals(daily_totals(df, "fid", "t"), "fid", {"w7": (-6, 0), "w30": (-29, 0), "ahead": (1, 30)}, tail_days=3)
    base = dt.date(2024, 1, 1)
    days = {}
    for k, t in e:
        if k and t:
            days.setdefault(k, []).append((t.date() - base).days)
    want = set()
    for k, v in days.items():
        for d in range(min(v), max(v) + 4):
            n = lambda a, z, d=d, v=v: sum(d + a <= x <= d + z for x in v)
            want.add((k, base + dt.timedelta(days=d), n(0, 0), n(-6, 0), n(-29, 0), n(1, 30)))
    assert {tuple(x) for x in r.collect()} == want
    assert rolling_totals(daily_totals(df.limit(0), "fid", "t"), "fid", {"w7": (-6, 0)}).count() == 0


# 7. orphans


def test_orphan_kinds(spark):
    p = [(1, 10, 20), (1, 15, 30), (1, 40, None), (2, 5, 5), (None, 1, 2), (3, None, 9), (1, 10, 12)]
    runs = lifetime_runs(spark.createDataFrame(p, "k bigint, s bigint, e bigint"), "k", "s", "e")
    assert rows(runs) == [(1, 10, 30, 1), (1, 40, None, 2)]
    assert rows(lifetime_runs(spark.createDataFrame(p, "k bigint, s bigint, e bigint"), "k", "s", "e", chunk_us=4)) == [(1, 10, 30, 1), (1, 40, None, 2)]
    refs = spark.createDataFrame([(1, 9), (1, 10), (1, 29), (1, 30), (1, 40), (2, 6), (3, 1), (None, 4), (1, None), (1, 9)], "fid bigint, t bigint")
    refs = refs.withColumns({"k": F.lit("x"), "side": F.lit(5), "e": F.lit(1), "salt": F.lit(1), "orphan_kind": F.lit("?"), "m": F.create_map(F.lit(1), F.lit(2))})
    got = sorted((r["fid"], r["t"], r["orphan_kind"], r["k"]) for r in orphans(refs, runs, "fid", "t").collect())
    assert got == [(1, 9, "later", "x"), (1, 9, "later", "x"), (1, 30, "gone", "x"), (2, 6, "never", "x"), (3, 1, "never", "x")]
    assert orphans(refs.limit(0), runs, "fid", "t").count() == 0
    assert orphans(refs, runs.limit(0), "fid", "t").where("orphan_kind = 'never'").count() == 8
    assert sorted((r["fid"], r["t"], r["orphan_kind"], r["k"]) for r in orphans(refs, runs, "fid", "t", integer_keys=True).collect()) == got
    assert orphans(refs, runs.limit(0), "fid", "t", integer_keys=True).where("orphan_kind = 'never'").count() == 8
    assert orphans(refs.limit(0), runs, "fid", "t", integer_keys=True).count() == 0


def test_integer_keys_are_compressed_to_runs(spark):
    rng = random.Random(6)
    keys = sorted({rng.choice([-1, 1]) * rng.randrange(1200) for _ in range(1500)} | {2**62, 2**62 + 1})
    df = spark.createDataFrame([(k,) for k in keys for _ in range(2)] + [(None,)], "fid bigint")
    runs = key_runs(df, "fid")
    got = sorted((a, z) for r in runs.collect() for a, z in r["runs"])
    assert [k for a, z in got for k in range(a, z + 1)] == keys and len(got) < len(keys)
    assert all(r["runs"] == sorted(r["runs"]) and len(r["runs"]) <= 128 for r in runs.collect())
    asked = list(range(-1300, 1300)) + [2**62 - 1, 2**62, 2**62 + 2]
    refs = spark.createDataFrame([(k,) for k in asked] + [(None,)], "fid bigint").withColumns({"at": F.lit(1), "runs": F.lit(2)})
    known = {r["fid"]: r["known__"] for r in with_known(refs, runs, "fid").collect()}
    assert known == {k: k in set(keys) for k in asked} | {None: False}
    assert not any(r["known__"] for r in with_known(refs, runs.limit(0), "fid").collect())


@pytest.mark.parametrize("most", [intervals.BROADCAST_RANGES, 0])
def test_a_hot_reference_key_is_split(spark, monkeypatch, most):
    monkeypatch.setattr(intervals, "BROADCAST_RANGES", most)
    refs = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("fid"), F.col("id").alias("t"))
    runs = lifetime_runs(spark.createDataFrame([(7, 100, 200), (4500, 0, None)], "k bigint, s bigint, e bigint"), "k", "s", "e")
    for ints in (False, True):
        got = orphans(refs, runs, "fid", "t", rows_per_task=300, integer_keys=ints).groupBy("orphan_kind").count().collect()
        assert {r["orphan_kind"]: r["count"] for r in got} == {"later": 100, "gone": 3800, "never": 999}


def test_micros_ignores_the_session_zone(spark):
    df = spark.createDataFrame([(at(0),), (None,)], "t timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert [r[0] for r in df.select(micros("t")).collect()] == [1_704_067_200_000_000, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
