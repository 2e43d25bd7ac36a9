"""The batch job end to end on a small network, label curation and file housekeeping."""

import random

import pytest
from pyspark.sql import functions as F

from rookery import service
from rookery.features import reputation
from rookery.ml import labels as L
from rookery.ml.models import ModelConfig


def test_job_publishes_and_answers(spark, tmp_path):
    rng = random.Random(4)
    bot = {i: i % 2 == 0 for i in range(80)}
    links = [(a, b) for a in bot for b in rng.sample(range(80), 12) if bot[a] == bot[b] or rng.random() < 0.1]
    links += [(b, a) for a, b in links]
    f = spark.createDataFrame([(i, float(b) + rng.gauss(0, 0.4), rng.random()) for i, b in bot.items()], "fid bigint, a double, b double")
    lab = spark.createDataFrame([(i, b) for i, b in bot.items() if i < 40], "fid bigint, bot boolean")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(81)], "fid bigint, fname string")
    c = service.JobConfig(str(tmp_path / "out"), "mean", 5, ("logistic",), ModelConfig(label="label"))
    for _ in range(2):  # a second run replaces, and does not add
        service.run_job(c, spark.createDataFrame(links, "fid bigint, target_fid bigint"), lab, f, names, 7)
    t = spark.read.parquet(c.out + "/scores")
    assert t.count() == 81 and t.columns == [x.name for x in service.SCORES.fields]
    held = [service.check_account(spark, c.out, fid=i)["result"] == ("sybil" if bot[i] else "benign") for i in range(40, 60)]
    assert sum(held) >= 17
    assert service.check_account(spark, c.out, fname="n3")["fid"] == 3
    assert service.check_account(spark, c.out, fid=80)["result"] is None and service.check_account(spark, c.out, fid=999)["result"] is None


def test_labels_from_texts(spark):
    rows = [("You are NOT A BOT.", "[5]", "[]", b"\x01"), ("like a bot", "[]", '[{"url":"https://x/y?fid=6"}]', b"\x02"), ("bot or low", "[5]", None, b"\x03"), ("hello", "[7]", "[]", b"\x04"), ("like a bot", "[]", "oops", b"\x05"), (None, "[9]", "[]", b"\x06")]
    got = sorted(tuple(r) for r in L.labels_from_texts(spark.createDataFrame(rows, "text string, mentions string, embeds string, hash binary")).collect())
    assert got == [(5, False, "0x01"), (6, True, "0x02")]


def test_attach_and_relabel(spark):
    df = spark.createDataFrame([(i, True if i < 3 else False if i < 5 else None) for i in range(50)], "fid bigint, bot boolean")
    keys = lambda *x: spark.createDataFrame([(i,) for i in x], "fid bigint")
    a = {r["fid"]: r["label"] for r in L.attach(df, keys(1, 1, 2), keys(2, 3)).collect()}
    assert (a[1], a[2], a[3], a[4]) == (1, 1, 0, None) and len(a) == 50
    r = L.relabelled(df, 10)
    assert r.where("bot").count() == 10 and r.where("NOT bot").count() == 2 and r.count() == 50
    assert sorted(x["fid"] for x in L.uncovered(keys(1, 2, 2), keys(1)).collect()) == [2]
    assert {(x["a"], x["b"], x["n"]) for x in L.agreement(df.where("fid < 5"), "bot", "bot").collect()} == {(True, True, 3), (False, False, 2)}


def test_reputation_of_one_event_and_nulls(spark):
    e = spark.createDataFrame([(1, 1, "reply", None, 2.0), (1, 2, "reply", None, None), (None, 3, "x", None, 1.0)], "fid bigint, id bigint, activity_type string, timestamp timestamp_ntz, impact_score double")
    assert reputation.activity_reputation(e).count() == 0  # nothing has a time
    one = reputation.activity_reputation(e.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))).first()
    assert one["peer_reputation"] == 2.0 and one["behavior_consistency"] == 0.0


def test_housekeeping(spark, tmp_path):
    src, dst = tmp_path / "a", tmp_path / "b"
    src.mkdir()
    for n in ("casts-1", "casts-2", "links-1"):
        (src / n).write_text(n)
    got = service.import_latest(spark, f"file://{src}", ["casts", "links", "none"], f"file://{dst}")
    assert set(got) == {"casts", "links"} and (dst / "links-1").read_text() == "links-1"
    assert service.purge(str(dst), ("links-1",)) and [p.name for p in dst.iterdir() if p.name[0] != "."] == ["links-1"]
    assert service.purge(str(tmp_path / "none")) == []
    with pytest.raises(ValueError):
        service.validate(spark.range(1), ["fid"])


def test_database_rows_are_replaced_by_key(spark):
    from rookery.sources.datasets import publish_jdbc

    url = "jdbc:derby:memory:rookery;create=true"
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, None)]):
        publish_jdbc(spark.createDataFrame(rows, "fid bigint, fname string"), url, "scores", "fid", batch_rows=1)
    assert sorted(tuple(r) for r in spark.read.jdbc(url, "scores").collect()) == [(1, "a"), (2, "c"), (3, None)]


def test_spine(spark):
    from rookery.sources.datasets import spine

    df = spark.createDataFrame([(5,), (1,), (1,), (None,), (3,)], "fid int")
    assert sorted(r[0] for r in spine(df, "fid").collect()) == [1, 3, 5]
    assert sorted(r[0] for r in spine(df, "fid", 2, [9, 1]).collect()) == [1, 3, 9]
