"""Stacking, segments, validation, single predictions and stored state."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from rookery import service, session
from rookery.features.registry import FeatureContext, FeatureManager, FeatureRegistry, FeatureSet
from rookery.functions.text import hex_amount
from rookery.ml import metrics as M
from rookery.ml import models
from rookery.ml import prepare as P
from rookery.ml import scoring as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = [(i, float(i % 2), i % 2 + rng.gauss(0, 0.7), rng.random(), "even" if i % 3 else "third") for i in range(240)]
    return spark.createDataFrame(out, "fid bigint, label double, a double, b double, segment string").cache()


CONFIG = models.ModelConfig(folds=3)


def test_stacking_weighs_learners_by_what_they_know(spark, rows):
    models.register("coin", lambda c, **kw: models.FACTORY["logistic"](c, regParam=1e6))
    try:
        s = models.stacking(rows, ["a", "b"], CONFIG, ["logistic", "coin"])
    finally:
        del models.FACTORY["coin"]
    assert abs(sum(s.weights.values()) - 1) < 1e-9 and s.weights["logistic"] > 0.4 and all(0 <= v < 0.05 for v in s.stability.values())
    t = s.transform(rows)
    assert M.roc_auc(t, "stacked", "label").first()[0] > 0.75
    r = t.first()
    assert r["weighted"] == pytest.approx(sum(w * r[f"p_{n}"] for n, w in s.weights.items()))


def test_out_of_fold_rows_are_scored_once(rows):
    o = models.out_of_fold(rows, ["a", "b"], CONFIG, ["logistic"])
    assert o.count() == o.select("fid").distinct().count() == 240 and {r[0] for r in o.select("fold").distinct().collect()} == {0, 1, 2}


def test_learners_are_compared_by_segment(rows):
    c = models.compare_segments(rows.withColumn("segment", F.when(F.col("fid") < 200, F.col("segment"))), "segment", ["a", "b"], CONFIG, ["logistic", "forest"])
    got = {(r["segment"], r["learner"]): r for r in c.collect()}
    assert set(got) == {(s, n) for s in ("even", "third") for n in ("logistic", "forest")}
    assert got["third", "forest"]["n"] == len([i for i in range(200) if i % 3 == 0]) and all(0.5 < r["f1"] <= 1 for r in got.values())


def test_calibration_uses_the_folds_of_the_config(rows, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "folds", lambda df, key, k, seed: (seen.append(k), P.folds(df, key, k, seed))[1])
    models.Ensemble(["a"], models.ModelConfig(folds=4), ("logistic",)).fit(rows)
    assert seen == [4]


def test_fits_of_an_ensemble_run_at_once_with_the_same_result(rows, monkeypatch):
    together, make = threading.Barrier(2, timeout=60), models.pipeline

    def meeting(*a, **kw):
        together.wait()  # a fit alone would wait in vain
        return make(*a, **kw)

    one = models.Ensemble(["a", "b"], CONFIG, ("gbt", "logistic"))
    monkeypatch.setattr(models, "AT_ONCE", 1)
    one.fit(rows)
    monkeypatch.undo()
    monkeypatch.setattr(models, "pipeline", meeting)
    many = models.Ensemble(["a", "b"], CONFIG, ("gbt", "logistic")).fit(rows)
    assert list(many.models) == ["gbt", "logistic"] and all(many.calibration[n] == pytest.approx(one.calibration[n]) for n in many.models)
    p = [{r["fid"]: r["adjusted"] for r in e.transform(rows).collect()} for e in (one, many)]
    assert p[0] == pytest.approx(p[1]) and len(p[0]) == 240


def test_importances_of_several_models():
    by = {"x": [("a", 0.5), ("b", 0.3), ("c", 0.2)], "y": [("c", 0.9), ("a", 0.05), ("b", 0.05)]}
    assert models.importance_union(by, 1) == ["c", "a"] and models.importance_union(by, 2) == ["c", "a", "b"] and models.importance_union({}, 3) == []


@pytest.mark.parametrize("bad,what", [([(None, 1)], "without a score"), ([(0.5, 2)], "not 0 or 1"), ([(1.5, 1)], "outside"), ([(float("nan"), 1)], "without"), ([], "no rows")])
def test_scores_are_validated(spark, bad, what):
    good = [] if not bad else [(0.0, 0), (1.0, 1)]
    with pytest.raises(ValueError, match=what):
        M.checked(spark.createDataFrame(good + bad, "p double, y int"), "p", "y")
    df = spark.createDataFrame([(0.0, 0), (1.0, 1)], "p double, y int")
    assert M.checked(df, "p", "y") is df


def test_negative_numbers_are_found(spark):
    df = spark.createDataFrame([(1, 0.0, None, "x"), (2, float("nan"), -3, "y")], "a int, b double, c bigint, d string")
    with pytest.raises(ValueError, match="negative values in c$"):
        P.check_non_negative(df)
    assert P.check_non_negative(df, ["a", "b"]) is df and P.check_non_negative(df.limit(0)).count() == 0


def test_population(spark):
    r = S.population(spark.createDataFrame([(0.1,), (0.5,), (0.9,), (None,), (float("nan"),)], "p double"), "p").first()
    assert (r["n"], r["n_above"], r["n_below"], r["median"], r["min"], r["max"]) == (3, 2, 1, 0.5, 0.1, 0.9) and r["mean"] == pytest.approx(0.5)
    assert S.population(spark.createDataFrame([], "p double"), "p").first()["n"] == 0


def test_hexadecimal_amounts(spark):
    x = ["0xde0b6b3a7640000", "DE0B6B3A7640000", "0x0", "0x00000000000000000000000000000000000000000000000000000000000001bc16d674ec80000", "0xzz", "", None, "0x" + "f" * 31, "0x" + "f" * 30]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, t string").orderBy("i").select(hex_amount("t")).collect()]
    assert got[:8] == [1.0, 1.0, 0.0, 2.0, None, None, None, None] and got[8] == pytest.approx((16**30 - 1) / 1e18)


def manager(spark, rows, folder, cache=None, delivery=""):
    r = FeatureRegistry()
    r.register(FeatureSet("one", ["a"], lambda c: rows.select("fid", "a")))
    r.register(FeatureSet("two", ["b"], lambda c: rows.select("fid", "b")))
    return FeatureManager(r, FeatureContext(spark, folder, delivery=delivery), cache)


def test_a_matrix_in_batches_is_the_same_with_few_joins(spark, rows):
    r = FeatureRegistry()
    for i in range(11):
        r.register(FeatureSet(f"s{i:02}", [f"c{i}", f"d{i}"], lambda c, i=i: rows.where(F.col("fid") % 11 != i).select("fid", (F.col("a") * i).alias(f"c{i}"), (F.col("fid") * i).alias(f"d{i}"))))
    spine = rows.select("fid").unionAll(spark.createDataFrame([(None,), (-7,)], "fid bigint"))
    one, few = (FeatureManager(r, FeatureContext(spark, "x"), batch=b).matrix(spine) for b in (None, 3))
    assert few.dtypes == one.dtypes and sorted(map(tuple, few.collect())) == sorted(map(tuple, one.collect())) and few.count() == 241
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")
    assert joins(one) == 11 and joins(few) <= 3


def test_one_account_is_built_and_scored(spark, rows):
    m = manager(spark, rows, "x")
    model = models.Ensemble(["b", "a"], CONFIG, ("logistic",)).fit(rows)
    names = spark.createDataFrame([(3, "three"), (4, "four")], "fid bigint, fname string")
    all_ = {r["fid"]: r["adjusted"] for r in model.transform(rows).where("fid IN (3, 4)").collect()}
    got = service.predict_account(m, model, fname="three", names=names)
    assert got["status"] == "ok" and got["fid"] == 3 and got["probability"] == pytest.approx(all_[3])
    assert service.predict_account(m, model, fid=4)["probability"] == pytest.approx(all_[4])
    assert service.predict_account(m, model, fname="none", names=names)["status"] == "not_found"
    model.columns.append("c")
    assert service.predict_account(m, model, fid=3) == {"fid": 3, "status": "feature_build_failed", "probability": None, "missing": ["c"]}


def test_a_cache_belongs_to_its_delivery(spark, rows, tmp_path):
    c = str(tmp_path / "cache")
    top = lambda df, *a: manager(spark, df, *a).matrix(rows.select("fid")).agg(F.max("a")).first()[0]
    first = top(rows, "x", c)
    higher = rows.withColumn("a", F.lit(99.0))
    assert top(higher, "x", c) == first  # the same delivery is read from the cache
    assert top(higher, "y", c) == 99.0 == top(higher, "x", c, "2")  # another folder and another delivery are built


def test_accounts_without_a_name_are_published(spark):
    g = spark.createDataFrame([(1, 0.9), (2, 0.1)], "fid bigint, graph_score double")
    m = spark.createDataFrame([(2, 0.3), (3, 0.5)], "fid bigint, model_score double")
    n = spark.createDataFrame([(1, "a"), (4, "d"), (None, "x")], "fid bigint, fname string")
    got = {r["fid"]: (r["fname"], r["sybil_probability"]) for r in service.published(g, m, n, "min").collect()}
    assert got == {1: ("a", pytest.approx(0.9)), 2: (None, pytest.approx(0.1)), 3: (None, pytest.approx(0.5)), 4: ("d", None)}


def test_reports_are_kept_by_id(spark, tmp_path):
    make = lambda *ids: spark.createDataFrame([(i, 1, 2, "0x1", None, 1, True, 0.5, None, None, None) for i in ids], service.REPORTS)
    for x in (make(1, 2), make(2, 3)):
        service.add_reports(x, str(tmp_path))
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/reports").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        service.add_reports(spark.range(1), str(tmp_path))


def test_written_tables_are_released(spark):
    n = session.cut_tables()
    t = session.cut(spark.range(5), "x")
    path = t.inputFiles()[0]
    assert session.cut_tables() == n + 1 and t.count() == 5
    assert session.release(spark, n) == n
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_a_swap_that_stopped_halfway_is_repaired(spark, tmp_path):
    from rookery.sources.datasets import upsert

    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path + ".old")
    upsert(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
