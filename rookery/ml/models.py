"""Base learners, calibration, ensembles and self-training on pyspark.ml."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.safe import count_if, scalars, sdiv
from rookery.ml.metrics import roc_auc
from rookery.ml.prepare import folds
from rookery.ml.scoring import soft_vote
from rookery.session import cut


@dataclass(frozen=True)
class ModelConfig:
    """Settings of a training run."""

    label: str = "label"
    key: str = "fid"
    seed: int = 42
    folds: int = 5
    weighted: bool = True


#: name -> builder of a classifier from its settings and keyword parameters
FACTORY: dict[str, Callable[..., object]] = {
    "gbt": lambda c, **kw: GBTClassifier(labelCol=c.label, featuresCol="features", weightCol="weight", seed=c.seed, maxIter=kw.pop("maxIter", 20), **kw),
    "forest": lambda c, **kw: RandomForestClassifier(labelCol=c.label, featuresCol="features", weightCol="weight", seed=c.seed, numTrees=kw.pop("numTrees", 30), **kw),
    "logistic": lambda c, **kw: LogisticRegression(labelCol=c.label, featuresCol="features", weightCol="weight", regParam=kw.pop("regParam", 0.01), **kw),
    "svm": lambda c, **kw: LinearSVC(labelCol=c.label, featuresCol="features", weightCol="weight", **kw),
}


def register(name: str, build: Callable[..., object]) -> None:
    """Add a learner; an existing name is replaced."""
    FACTORY[name] = build


def with_weights(df: DataFrame, config: ModelConfig) -> DataFrame:
    """``df`` with weight: classes count the same in total. One aggregate of two counts."""
    if not config.weighted:
        return df.withColumn("weight", F.lit(1.0))
    v = scalars(df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(config.label).cast("double")).alias("p")))
    share = F.when(F.col(config.label).cast("int") == 1, v("p")).otherwise(v("n") - v("p"))
    return df.withColumn("weight", v("n") / (2.0 * F.greatest(share, F.lit(1.0))))


def pipeline(name: str, columns: Sequence[str], config: ModelConfig, **params: object) -> Pipeline:
    """Assemble, standardise and classify; rows with a null feature are an error, see :mod:`rookery.ml.prepare`."""
    if name not in FACTORY:
        raise KeyError(f"no learner {name}; there are {', '.join(sorted(FACTORY))}")
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), FACTORY[name](config, **params)])


#: fits that run at the same time: each is a chain of some hundred short jobs, which wait for the scheduler more than they compute
AT_ONCE = 4


def at_once(spark: SparkSession, steps: Sequence[Callable[[], object]]) -> list:
    """The results of independent steps in their order, :data:`AT_ONCE` of them at a time."""
    with ThreadPool(max(1, min(AT_ONCE, len(steps)))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(spark)(f) for f in steps], chunksize=1)


def probability(df: DataFrame, out: str) -> DataFrame:
    """``df`` with the probability of class 1 instead of the model's vectors; margins go through the logistic function."""
    p = vector_to_array("probability")[1] if "probability" in df.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return df.withColumn(out, p).drop("raw", "features", "rawPrediction", "probability", "prediction")


@dataclass
class Ensemble:
    """Learners calibrated out of fold and combined by soft voting."""

    columns: list[str]
    config: ModelConfig = field(default_factory=ModelConfig)
    names: Sequence[str] = ("gbt", "forest", "logistic")
    models: dict[str, PipelineModel] = field(default_factory=dict)
    calibration: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Ensemble:
        """Fit each learner on all rows and its sigmoid calibration on scores from folds it was not fitted on."""
        c = self.config
        # written, not persisted: each of the many jobs would otherwise be sent out with the whole lineage of the rows
        data = cut(with_weights(df, c).select(c.key, c.label, "weight", *self.columns), "training")
        parts = folds(data, c.key, c.folds, c.seed)
        sets = [data, *(parts.where(F.col("fold") != i) for i in range(c.folds))]
        spark = df.sparkSession
        # what comes before the learner is the same for all of them
        before = at_once(spark, [lambda x=x: Pipeline(stages=pipeline(self.names[0], self.columns, c).getStages()[:-1]).fit(x) for x in sets])
        learn = lambda n, b, x: PipelineModel([*b.stages, pipeline(n, self.columns, c).getStages()[-1].fit(b.transform(x))])
        got = at_once(spark, [lambda n=n, b=b, x=x: learn(n, b, x) for n in self.names for b, x in zip(before, sets)])
        by = {n: got[i * len(sets) : (i + 1) * len(sets)] for i, n in enumerate(self.names)}
        self.models = {n: m[0] for n, m in by.items()}
        self.calibration = dict(zip(by, at_once(spark, [lambda m=m: self._calibrate(m[1:], parts) for m in by.values()])))
        return self

    def _calibrate(self, fitted: Sequence[PipelineModel], parts: DataFrame) -> tuple[float, float]:
        """``fitted``: one model per fold, which has not seen it."""
        c = self.config
        out: DataFrame | None = None
        for i, m in enumerate(fitted):
            s = probability(m.transform(parts.where(F.col("fold") == i)), "p").select("p", c.label, "weight")
            out = s if out is None else out.unionAll(s)
        logit = F.ln(F.greatest("p", F.lit(1e-6)) / F.greatest(1 - F.col("p"), F.lit(1e-6)))
        x = VectorAssembler(inputCols=["z"], outputCol="features").transform(cut(out.select(logit.alias("z"), c.label, "weight"), "calibration"))
        lr = LogisticRegression(labelCol=c.label, featuresCol="features", weightCol="weight").fit(x)
        return float(lr.coefficients[0]), float(lr.intercept)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with p_<learner>, vote, adjusted and confidence."""
        out = df
        for name, m in self.models.items():
            a, b = self.calibration[name]
            out = probability(m.transform(out), f"p_{name}")
            p = F.col(f"p_{name}")
            z = F.ln(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))
            out = out.withColumn(f"p_{name}", 1 / (1 + F.exp(-(a * z + b))))
        return soft_vote(out, [f"p_{n}" for n in self.models])

    def importance(self) -> list[tuple[str, float]]:
        """Features by mean importance over the learners (trees' gains, coefficients' shares), greatest first."""
        total = dict.fromkeys(self.columns, 0.0)
        for m in self.models.values():
            last = m.stages[-1]
            v = [abs(x) for x in (last.featureImportances.toArray() if hasattr(last, "featureImportances") else last.coefficients.toArray())]
            s = sum(v) or 1.0
            for c, x in zip(self.columns, v):
                total[c] += x / s / len(self.models)
        return sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))

    def save(self, path: str) -> None:
        for name, m in self.models.items():
            m.write().overwrite().save(f"{path}/{name}")
        meta = json.dumps({"columns": self.columns, "names": list(self.models), "calibration": self.calibration, "label": self.config.label, "key": self.config.key})
        SparkSession.active().createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(path: str) -> Ensemble:
        meta = json.loads(SparkSession.active().read.text(f"{path}/meta").first()[0])
        e = Ensemble(meta["columns"], ModelConfig(label=meta["label"], key=meta["key"]), meta["names"])
        e.models = {n: PipelineModel.load(f"{path}/{n}") for n in meta["names"]}
        e.calibration = {n: tuple(v) for n, v in meta["calibration"].items()}
        return e


def importance_union(by_model: dict[str, Sequence[tuple[str, float]]], k: int = 10) -> list[str]:
    """Features among the ``k`` most important of any model, in order of their greatest importance; ties by name."""
    best: dict[str, float] = {}
    for ranked in by_model.values():
        for c, x in sorted(ranked, key=lambda r: (-r[1], r[0]))[:k]:
            best[c] = max(x, best.get(c, 0.0))
    return sorted(best, key=lambda c: (-best[c], c))


def out_of_fold(df: DataFrame, columns: Sequence[str], config: ModelConfig, names: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(key, label, weight, fold, extra, p_<learner> ...): each row scored by learners fitted on the other folds."""
    parts = folds(with_weights(df, config), config.key, config.folds, config.seed)
    out: DataFrame | None = None
    for i in range(config.folds):
        have, asked = parts.where(F.col("fold") != i), parts.where(F.col("fold") == i)
        for n in names:
            asked = probability(pipeline(n, columns, config).fit(have).transform(asked), f"p_{n}")
        got = asked.select(config.key, config.label, "weight", "fold", *extra, *[f"p_{n}" for n in names])
        out = got if out is None else out.unionAll(got)
    assert out is not None, "at least one fold"
    return out


@dataclass
class Stacked:
    """A meta-learner over the out-of-fold probabilities of base learners, with their weights and stability."""

    base: dict[str, PipelineModel]
    meta: PipelineModel
    weights: dict[str, float]  # proportional to the area under the curve out of fold
    stability: dict[str, float]  # variance of that area over the folds

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with p_<learner>, stacked (of the meta-learner) and weighted (the vote by weights)."""
        out = df
        for n, m in self.base.items():
            out = probability(m.transform(out), f"p_{n}")
        out = probability(self.meta.transform(out), "stacked")
        vote = F.lit(0.0)
        for n, w in self.weights.items():
            vote = vote + w * F.col(f"p_{n}")
        return out.withColumn("weighted", vote)


def stacking(df: DataFrame, columns: Sequence[str], config: ModelConfig, names: Sequence[str] = ("gbt", "forest", "logistic")) -> Stacked:
    """Fit base learners on all rows, and a logistic meta-learner on what they say out of fold.

    A fold without one of the classes says nothing about stability; learners no better than chance weigh 0, and
    equally if none is.
    """
    seen = cut(out_of_fold(df, columns, config, names), "stack")
    area = {n: roc_auc(seen, f"p_{n}", config.label).first()[0] or 0.5 for n in names}
    by_fold = {n: [x for i in range(config.folds) if (x := roc_auc(seen.where(F.col("fold") == i), f"p_{n}", config.label).first()[0]) is not None] for n in names}
    gain = {n: max(a - 0.5, 0.0) for n, a in area.items()}
    total = sum(gain.values())
    weights = {n: g / total if total else 1 / len(names) for n, g in gain.items()}
    spread = {n: sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v) if v else 0.0 for n, v in by_fold.items()}
    meta = Pipeline(stages=[VectorAssembler(inputCols=[f"p_{n}" for n in names], outputCol="features"), LogisticRegression(labelCol=config.label, featuresCol="features", weightCol="weight")]).fit(seen)
    data = with_weights(df, config)
    return Stacked({n: pipeline(n, columns, config).fit(data) for n in names}, meta, weights, spread)


def compare_segments(df: DataFrame, segment: str, columns: Sequence[str], config: ModelConfig, names: Sequence[str] = ("forest", "logistic"), threshold: float = 0.5) -> DataFrame:
    """(segment, learner, n, precision, recall, f1): cross-validated quality of each learner in each segment.

    Learners are fitted on the other folds of all segments; rows with a null segment take part in fitting only.
    """
    seen = out_of_fold(df, columns, config, names, extra=[segment]).where(F.col(segment).isNotNull())
    cells = F.array(*[F.struct(F.lit(n).alias("learner"), (F.col(f"p_{n}") >= threshold).alias("said")) for n in names])
    x = seen.select(F.col(segment).alias("segment"), (F.col(config.label) == 1).alias("is"), F.explode(cells).alias("c"))
    a = x.groupBy("segment", "c.learner").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("is") & F.col("c.said")).alias("tp"), count_if(~F.col("is") & F.col("c.said")).alias("fp"), count_if(F.col("is") & ~F.col("c.said")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.select("segment", "learner", "n", sdiv(tp, tp + fp).alias("precision"), sdiv(tp, tp + fn).alias("recall"), sdiv(2 * tp, 2 * tp + fp + fn).alias("f1"))


def tuned(name: str, df: DataFrame, columns: Sequence[str], config: ModelConfig, grid: dict[str, Sequence[object]]) -> PipelineModel:
    """The best of a parameter grid by cross-validated area under the precision-recall curve; class weights are kept."""
    p = pipeline(name, columns, config)
    stage = p.getStages()[-1]
    b = ParamGridBuilder()
    for k, v in grid.items():
        b = b.addGrid(stage.getParam(k), list(v))
    cv = CrossValidator(estimator=p, estimatorParamMaps=b.build(), evaluator=BinaryClassificationEvaluator(labelCol=config.label, metricName="areaUnderPR"), numFolds=config.folds, seed=config.seed, parallelism=4)
    return cv.fit(with_weights(df, config)).bestModel


def self_training(labelled: DataFrame, unlabelled: DataFrame, columns: Sequence[str], config: ModelConfig, name: str = "logistic", threshold: float = 0.9, rounds: int = 5) -> tuple[PipelineModel, DataFrame]:
    """(model, labelled rows in the end): confident predictions join the training rows until none is left to join."""
    have, rest = labelled.select(config.key, *columns, config.label), unlabelled.select(config.key, *columns)
    model = pipeline(name, columns, config).fit(with_weights(have, config))
    for _ in range(rounds):
        s = probability(model.transform(rest), "p")
        sure = s.where((F.col("p") >= threshold) | (F.col("p") <= 1 - threshold)).select(config.key, *columns, (F.col("p") >= 0.5).cast("int").alias(config.label))
        if sure.isEmpty():
            break
        have = have.unionByName(sure.withColumn(config.label, F.col(config.label).cast(have.schema[config.label].dataType)))
        rest = rest.join(sure.select(config.key), config.key, "left_anti")
        model = pipeline(name, columns, config).fit(with_weights(have, config))
    return model, have


def clusters(df: DataFrame, columns: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """``df`` with cluster: k-means on standardised columns."""
    p = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")])
    return p.fit(df).transform(df).drop("raw", "features")


def permutation_importance(predict: Callable[[DataFrame], DataFrame], df: DataFrame, columns: Sequence[str], key: str, score: Callable[[DataFrame], float]) -> list[tuple[str, float]]:
    """Loss of ``score`` when one column's values are dealt to other rows, greatest first.

    Values are dealt by joining ranks of two pseudo-random orders inside hash slices of the rows.
    """
    from pyspark.sql import Window

    base = score(predict(df))
    out = []
    slice_ = F.pmod(F.xxhash64(key), F.lit(64))
    w = Window.partitionBy("s__").orderBy("o__", key)
    for c in columns:
        a = df.withColumn("s__", slice_).withColumn("o__", F.xxhash64(key, F.lit(1))).withColumn("r__", F.row_number().over(w))
        b = df.select(key, F.col(c).alias("v__")).withColumn("s__", slice_).withColumn("o__", F.xxhash64(key, F.lit(2))).withColumn("r__", F.row_number().over(w)).drop(key, "o__")
        dealt = a.drop(c).join(b, ["s__", "r__"]).withColumnRenamed("v__", c).drop("s__", "r__", "o__")
        out.append((c, base - score(predict(dealt))))
    return sorted(out, key=lambda x: (-x[1], x[0]))
