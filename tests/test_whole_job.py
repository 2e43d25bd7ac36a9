"""Registered queries do the whole job of their operators."""

import datetime as dt
import math

import pytest
from harness import DATA, compare, connect

from rookery.ml import models
from rookery.plans import exchange, features, graph, learning


@pytest.fixture(scope="module")
def path_graph(spark, tmp_path_factory):
    """A path of 410 mutual followers; its first account is benign, its last a bot."""
    d, n, t = tmp_path_factory.mktemp("path"), 410, dt.datetime(2024, 1, 1)
    f = [(a, b, t, t, None, t) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))]
    spark.createDataFrame(f, "fid bigint, target_fid bigint, timestamp timestamp_ntz, created_at timestamp_ntz, deleted_at timestamp_ntz, export_ts timestamp_ntz").write.parquet(f"{d}/follows.parquet")
    c = [(0, 9, 1, t, t), (n - 1, 1, 9, t, t)]
    spark.createDataFrame(c, "fid bigint, follower_count bigint, following_count bigint, created_at timestamp_ntz, export_ts timestamp_ntz").write.parquet(f"{d}/follow_counts.parquet")
    return str(d), n


def test_rank_walks_as_far_as_the_graph_asks(spark, path_graph):
    d, n = path_graph
    near = lambda i: [j for j in (i - 1, i + 1) if 0 <= j < n]
    prior = [1.0] + [0.0] * (n - 1)
    post = prior
    assert int(math.log(n)) == 6
    for _ in range(6):
        post = [0.85 * sum(post[j] / len(near(j)) for j in near(i)) + 0.15 * prior[i] for i in range(n)]
    got = {r["id"]: r["rank"] for r in graph.sybilrank(spark, d).collect()}
    assert got[6] > 0 and got[7] == 0
    assert all(abs(got[i] - post[i] / len(near(i))) < 1e-6 for i in range(n))


def test_belief_passes_five_rounds_of_messages(spark, path_graph):
    d, n = path_graph
    got = {r["id"]: r["posterior"] for r in graph.sybilbelief(spark, d).collect()}
    # along a path from the seed every hop takes the belief 0.8 nearer to one half; nothing comes back
    want = [0.5 + 0.4 * 0.8**i for i in range(6)]
    assert all(abs(got[i] - want[i]) < 1e-6 and abs(got[n - 1 - i] - (1 - want[i])) < 1e-6 for i in range(6))
    assert got[6] == 0.5


def test_matrix_has_every_group(spark):
    sf = f"{DATA}/sf0.001"
    m = features.feature_matrix_all(spark, sf)
    groups = set(features.QUERIES) - {"latest_names", "target_of_cast", "feature_matrix", "feature_matrix_all"}
    width = sum(len(features.QUERIES[n](spark, sf).columns) - 1 for n in groups)
    assert len(groups) == 41 and len(m.columns) == len(set(m.columns)) == 1 + width


def test_self_training_goes_on_past_two_refits(spark, monkeypatch):
    # labels that a fifth contradicts: every refit on what has joined is sure of a little more
    cols = learning._COLUMNS
    row = lambda i, x: (i, float(x), *[0.0] * (len(cols) - 1))
    kinds = "fid bigint, " + ", ".join(f"{c} double" for c in cols)
    have = spark.createDataFrame([(*row(i, 1 if i % 2 else -1), float((i % 2 == 1) != (i % 10 < 2))) for i in range(20)], kinds + ", label double").coalesce(1)
    rest = spark.createDataFrame([row(1000 + i, (i - 50) / 25) for i in range(101)], kinds).coalesce(1)
    monkeypatch.setattr(learning, "_training", lambda *_: (have, rest))
    two = models.self_training(have, rest, cols, models.ModelConfig(), rounds=2)[1].count()
    assert 20 < two < learning.self_training(spark, "").count()


def test_hexadecimal_amounts_beyond_bigint(spark, tmp_path):
    keys = [0, 1, 922337, 922338, 36_000_001, 7_777_777_777, 2**53 - 1, 2**63 - 1, -3, -922338, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r[0]: r[1] for r in exchange.hex_amounts(spark, str(tmp_path)).collect()}
    assert got == {k: None if k is None else float(k * 10**13) / 1e18 for k in keys}
    assert compare(spark, connect(str(tmp_path)), exchange.hex_amounts, exchange.ORACLE["hex_amounts"], str(tmp_path)) == ""
