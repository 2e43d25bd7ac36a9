"""Every query with an SQL twin, on whole small tables; features, graph and model parts on hand-made ones."""

import math
import random

import numpy as np
import pytest
from harness import DATA, compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rookery.features.gaps import nearest_quantiles, with_gaps
from rookery.features.temporal import trends
from rookery.features.registry import FeatureContext, FeatureManager, FeatureRegistry, FeatureSet
from rookery.functions import safe
from rookery.functions import text as X
from rookery.graph import edges as E
from rookery.graph import propagate as P
from rookery.ml import metrics, models, prepare, scoring
from rookery.sources import datasets as D

SF = f"{DATA}/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert compare(spark, duck, entry.queries()[name], SQL[name], SF) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_division_policy(spark):
    r = spark.sql("SELECT 1.0D AS a, 0.0D AS z, -1.0D AS b, CAST(NULL AS DOUBLE) AS n")
    got = r.select(safe.sdiv("a", "z"), safe.sdiv("a", "z", True), safe.sdiv("b", "z", True), safe.sdiv("z", "z", True), safe.sdiv("n", "z", True), safe.sdiv("a", "b")).first()
    assert got[0] is None and got[1] == math.inf and got[2] == -math.inf and math.isnan(got[3]) and got[4] is None and got[5] == -1


def test_null_counts_as_a_value(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    assert df.agg(safe.nunique("x")).first()[0] == 2
    assert df.where("x IS NOT NULL").agg(safe.nunique("x")).first()[0] == 1


@pytest.mark.parametrize("n", range(1, 8))
def test_nearest_quantile(spark, n):
    v = [3, 9, 1, 7, 5, 11, 2][:n]
    df = spark.createDataFrame([(1, x) for x in v], "k int, v int")
    want = {q: sorted(v)[math.floor((n - 1) * q + 0.5)] for q in (0.1, 0.5, 0.9)}
    got = nearest_quantiles(df, "k", "v", list(want)).first()
    assert [got["q10"], got["q50"], got["q90"]] == list(want.values())
    assert df.agg(safe.nearest_quantile("v", 0.5)).first()[0] == want[0.5]


def test_gaps_truncate_and_cross_chunks(spark):
    ts = ["2024-01-30 00:00:00", "2024-01-30 00:59:59", "2024-01-30 01:59:59", "2024-02-01 02:00:00", "2024-05-01 00:00:00"]
    rows = [(1, i, t) for i, t in enumerate(ts)] + [(2, 0, ts[1]), (1, 9, None), (None, 1, ts[0])]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "fid int, id int, t string").selectExpr("fid", "id", "CAST(t AS TIMESTAMP_NTZ) AS t")
    got = [(r["fid"], r["id"], r["gap_h"], r["gap_m"]) for r in with_gaps(df, "fid", "t", "id").orderBy("fid", "id").collect()]
    assert got == [(1, 0, None, None), (1, 1, 0, 59), (1, 2, 1, 60), (1, 3, 48, 2880), (1, 4, 2158, 129480), (2, 0, None, None)]


def test_text_functions(spark):
    df = spark.createDataFrame([("alice.eth",), ("user12345",), ("a__b",), ("Farm Degen 2023",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(X.has("ens", "s"), X.has("random_numbers", "s"), X.has("excessive_symbols", "s"), X.has("airdrop_terms", "s"), X.has("has_year", "s")).collect()]
    assert got == [(True, False, False, False, False), (False, True, False, False, False), (False, False, True, False, False), (False, True, False, True, True), (False,) * 5, (None,) * 5]
    j = spark.createDataFrame([("[]",), ("[1,2]",), ("",), (None,), ("[1",)], "s string")
    assert [r[0] for r in j.select(X.json_list_size("s")).collect()] == [0, 2, 0, 0, 0]
    a = spark.createDataFrame([('["0x' + "a" * 40 + '","0x' + "a" * 40 + '","bad"]',), ("x",), (None,)], "s string")
    assert [len(r[0]) for r in a.select(X.address_list("s")).collect()] == [1, 0, 0]
    assert spark.range(1).select(X.url_parameter(F.lit("http://a/b?x=1&fid=7#z"), "fid"), X.hex_of(F.lit(b"\x0f"))).first()[:] == ("7", "0x0f")


def _graph(seed, n=40, m=120):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}), {i: rng.random() < 0.5 for i in range(0, n, 4)}


def _frames(spark, pairs, labels):
    e = E.symmetric(spark.createDataFrame(pairs, "a bigint, b bigint"))
    return e, spark.createDataFrame(list(labels.items()), "fid bigint, bot boolean")


def test_scar_equals_dense(spark):
    pairs, labels = _graph(1)
    nodes = sorted({x for p in pairs for x in p})
    ix = {v: i for i, v in enumerate(nodes)}
    a = np.zeros((len(nodes),) * 2)
    for u, v in pairs:
        a[ix[u], ix[v]] = a[ix[v], ix[u]] = 1
    prior = np.array([0.0 if v not in labels else -0.1 if labels[v] else 0.1 for v in nodes])
    post = prior.copy()
    for _ in range(10):
        post = np.clip(post + prior + 0.2 * a @ post, -0.5, 0.5)
    got = {r["id"]: r["posterior"] for r in P.sybil_scar(*_frames(spark, pairs, labels)).collect()}
    assert max(abs(got[v] - post[ix[v]] - 0.5) for v in nodes) < 1e-9


def test_hubs_in_slices_change_nothing(spark):
    e, _ = _frames(spark, [(0, i) for i in range(1, 30)], {})
    v = e.select(F.col("src").alias("id")).distinct().withColumn("prior", F.lit(0.01)).withColumn("post", F.col("id") / 100)
    run = lambda hub: {r["id"]: r["post"] for r in P.propagate(v, e.withColumn("weight", F.lit(0.1)), lambda p, q, g: p + q + g, 3, hub_degree=hub).collect()}
    a, b = run(1_000_000), run(4)
    assert len(a) == 30 and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_blocks_change_no_trend(spark):
    rng = random.Random(9)
    rows = [(k, i, 1_700_000_000 + i * 3600 + rng.randrange(90_000)) for k in (1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "fid int, id int, s bigint").selectExpr("fid", "id", "CAST(timestamp_seconds(s) AS TIMESTAMP_NTZ) AS timestamp")
    one, many = (sorted(tuple(r) for r in trends(df, block=b).collect()) for b in (20_000, 30))
    assert one == many and len(one) == 2


def test_rank_equals_dense(spark):
    pairs, labels = _graph(2)
    nodes = sorted({x for p in pairs for x in p})
    ix = {v: i for i, v in enumerate(nodes)}
    a = np.zeros((len(nodes),) * 2)
    for u, v in pairs:
        a[ix[u], ix[v]] = a[ix[v], ix[u]] = 1
    deg = a.sum(1)
    prior = np.array([float(v in labels and not labels[v]) for v in nodes])
    post = prior.copy()
    for _ in range(int(math.log(len(nodes)))):
        post = 0.85 * a.T @ (post / deg) + 0.15 * prior
    e, l = _frames(spark, pairs, labels)
    got = {r["id"]: r["rank"] for r in P.sybil_rank(e, l.where("NOT bot").select(F.col("fid").alias("id"))).collect()}
    assert max(abs(got[v] - post[ix[v]] / deg[ix[v]]) for v in nodes) < 1e-9


def test_belief_on_a_tree_is_exact(spark):
    # on a tree, belief propagation gives the true marginals
    pairs, labels = [(0, 1), (1, 2), (1, 3), (3, 4)], {0: False, 4: True}
    w, p = 0.9, {0: 0.9, 4: 0.1}
    tot, one = 0.0, dict.fromkeys(range(5), 0.0)
    for bits in range(32):
        x = [bits >> i & 1 for i in range(5)]
        q = math.prod(p.get(i, 0.5) if x[i] else 1 - p.get(i, 0.5) for i in range(5)) * math.prod(w if x[a] == x[b] else 1 - w for a, b in pairs)
        tot += q
        for i in range(5):
            one[i] += q * x[i]
    got = {r["id"]: r["posterior"] for r in P.sybil_belief(*_frames(spark, pairs, labels), rounds=5).collect()}
    assert all(abs(got[i] - one[i] / tot) < 1e-9 for i in range(5))


def test_edges(spark):
    links = [(1, 2), (2, 1), (2, 1), (1, 3), (4, 4), (5, 6), (5, 6), (None, 1)]
    df = spark.createDataFrame(links, "fid bigint, target_fid bigint")
    assert [tuple(r) for r in E.mutual_pairs(df).collect()] == [(1, 2)]
    assert [tuple(r) for r in E.mutual_pairs_by_join(df).collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in E.node_ids(df, "fid", 3).collect()) == [(1, 0), (2, 1), (4, 2), (5, 3)]
    t = {r["fid"]: (r["triangles"], r["clustering"]) for r in E.triangles(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a bigint, b bigint")).collect()}
    assert t == {1: (1, 1.0), 2: (1, 1.0), 3: (1, round(1 / 3, 6)), 4: (0, 0.0)}


def test_auc_with_ties(spark):
    s = [(0.1, 0), (0.4, 0), (0.4, 1), (0.4, 1), (0.8, 1), (0.9, 0), (None, 1)]
    won = [1.0 if a > b else 0.5 if a == b else 0.0 for a, y in s[:6] if y for b, z in s[:6] if not z]
    got = metrics.roc_auc(spark.createDataFrame(s, "s double, y int"), "s", "y").first()[0]
    assert abs(got - sum(won) / len(won)) < 1e-12
    assert metrics.roc_auc(spark.createDataFrame([(0.1, 1)], "s double, y int"), "s", "y").first()[0] is None


def test_score_pairs(spark):
    df = spark.createDataFrame([(None, None), (0.2, None), (None, 0.81), (0.8, 0.8), (0.2, 1.0)], "a double, b double")
    assert [tuple(r)[2:] for r in scoring.combine(df, "a", "b").collect()] == [(None, None), (0.2, False), (0.81, True), (0.8, None), (0.6, None)]
    assert scoring.combine(df, "a", "b", "min").collect()[4]["score"] == 0.2
    v = scoring.soft_vote(spark.createDataFrame([(0.9, 0.9, 0.9), (0.1, 0.9, 0.5)], "a double, b double, c double"), ["a", "b", "c"]).collect()
    assert abs(v[0]["adjusted"] - 0.9) < 1e-9 and abs(v[1]["vote"] - 0.5) < 1e-9 and v[1]["confidence"] < v[0]["confidence"]


def test_preparation(spark):
    df = spark.createDataFrame([(1, 1.0), (2, math.inf), (3, math.nan), (4, None), (5, 3.0), (6, 1e12)], "fid int, x double")
    got = [r["x"] for r in prepare.clean_matrix(df, ["x"]).orderBy("fid").collect()]
    assert got == [1.0, 3.0, 3.0, 3.0, 3.0, 1e9]
    assert [r[0] for r in prepare.bad_rows(df, "fid").collect()] == [2]
    with pytest.raises(ValueError, match="x"):
        prepare.check_matrix(df.withColumn("y", F.lit(1)), "y", ["x"])
    n = spark.range(10_000).withColumnRenamed("id", "fid")
    assert abs(prepare.holdout(n, "fid", 0.2).where("is_test").count() - 2000) < 100
    assert prepare.sample_n(n, "fid", 7).count() == 7
    assert sorted(r[0] for r in prepare.folds(n, "fid").select("fold").distinct().collect()) == [0, 1, 2, 3, 4]


def test_ensemble_learns_and_survives_saving(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, float(y), y + rng.gauss(0, 0.5), rng.random()) for i in range(300) for y in [rng.random() < 0.3]]
    df = spark.createDataFrame(data, "fid bigint, label double, a double, b double")
    e = models.Ensemble(["a", "b"], names=("forest", "logistic")).fit(df)
    s = e.transform(df)
    assert metrics.roc_auc(s, "vote", "label").first()[0] > 0.85
    assert e.importance()[0][0] == "a"
    e.save(str(tmp_path / "m"))
    again = {r["fid"]: r["vote"] for r in models.Ensemble.load(str(tmp_path / "m")).transform(df).collect()}
    assert all(abs(again[r["fid"]] - r["vote"]) < 1e-9 for r in s.collect())
    best = models.tuned("logistic", df, ["a", "b"], models.ModelConfig(folds=2), {"regParam": [0.01, 1.0]})
    assert best.stages[-1].getRegParam() in (0.01, 1.0)
    with pytest.raises(KeyError):
        models.pipeline("none", ["a"], models.ModelConfig())


def test_sources(spark, tmp_path):
    d = str(tmp_path)
    old, new = [(1, "old")], [(1, "new"), (2, "b"), (None, "c")]
    spark.createDataFrame(old, "fid bigint, v string").write.parquet(f"{d}/export-casts-0-999.parquet")
    spark.createDataFrame(new, "fid bigint, v string").write.parquet(f"{d}/export-casts-0-1000.parquet")
    c = D.DatasetCatalog(spark, d)
    assert c.load("casts").count() == 3 and c.columns("casts") == ["fid", "v"]
    assert [tuple(r) for r in c.load("casts", columns=["v"], fids=[1]).collect()] == [(1, "new")]
    assert c.load("casts", fids=spark.createDataFrame([(2,), (2,)], "fid bigint")).count() == 1
    assert c.load("casts", fids=range(5000)).count() == 2
    with pytest.raises(FileNotFoundError):
        c.load("links")
    (tmp_path / "seeds.txt").write_text("1 2 3\n4 5\n")
    assert sorted(tuple(r) for r in D.read_seeds(spark, f"{d}/seeds.txt").collect()) == [(1, True), (2, True), (3, True), (4, False), (5, False)]
    (tmp_path / "g.txt").write_text("1 2 0.7\n2 1\n\n")
    assert sorted((r[0], r[1], r[2]) for r in D.read_edges(spark, f"{d}/g.txt").collect()) == [(1, 2, 0.7), (2, 1, None)]
    D.write_posteriors(spark.createDataFrame([(7, 0.25)], "id bigint, posterior double"), f"{d}/p")
    assert spark.read.text(f"{d}/p").first()[0] == "7 0.2500000000"
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        D.upsert(spark.createDataFrame(rows, "fid bigint, v string"), f"{d}/t", "fid")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{d}/t").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert D.read_marker(f"{d}/m.json") is None
    D.write_marker(f"{d}/m.json", 5)
    assert D.read_marker(f"{d}/m.json") == 5
    with pytest.raises(ValueError, match="missing"):
        D.validate(spark.range(1), ["fid"])
    w = D.with_defaults(spark.createDataFrame([(None,)], "a double"), {"a": 1.0, "b": 2}).first()
    assert tuple(w) == (1.0, 2)


def test_feature_registry(spark, tmp_path):
    built = []

    def make(name, value, needs=()):
        def build(c):
            built.append(name)
            return c.spark.createDataFrame([(1, value), (2, value)], f"fid bigint, {name}_x double")

        return FeatureSet(name, [f"{name}_x"], build, needs)

    r = FeatureRegistry()
    r.register(make("a", 1.0, ["b"]))
    r.register(make("b", 2.0))
    assert r.order() == ["b", "a"] and r.provider("a_x") == "a" and r.available() == ["a_x", "b_x"]
    with pytest.raises(ValueError):
        r.register(FeatureSet("c", ["a_x"], lambda c: None))
    spine = spark.createDataFrame([(1,), (3,), (1,), (None,)], "fid bigint")
    m = FeatureManager(r, FeatureContext(spark, ""), str(tmp_path / "cache"))
    assert sorted(tuple(x) for x in m.matrix(spine).collect()) == [(1, 2.0, 1.0), (3, 0.0, 0.0)]
    again = FeatureManager(r, FeatureContext(spark, ""), str(tmp_path / "cache"))
    assert again.features_for([2]).collect()[0]["a_x"] == 1.0 and built == ["b", "a"]
    r.register(FeatureSet("d", ["d_x"], lambda c: None, ["e"]))
    r.register(FeatureSet("e", ["e_x"], lambda c: None, ["d"]))
    with pytest.raises(ValueError, match="itself"):
        r.order()
