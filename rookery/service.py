"""The batch job from tables to published scores, and the look-up over its result."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.features.registry import FeatureManager
from rookery.graph.edges import mutual_pairs, symmetric
from rookery.graph.propagate import sybil_scar
from rookery.ml.models import Ensemble, ModelConfig
from rookery.ml.prepare import clean_matrix
from rookery.ml.scoring import combine
from rookery.sources.datasets import numeric_columns, upsert, validate, write_marker

#: What the job publishes, one row per account.
SCORES = T.StructType(
    [
        T.StructField("fid", T.LongType(), False),
        T.StructField("fname", T.StringType()),
        T.StructField("sybil_probability", T.FloatType()),
        T.StructField("sybil_diagnosis", T.BooleanType()),
        T.StructField("last_updated", T.TimestampType(), False),
    ]
)


#: What accounts report about others, one row per report.
REPORTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("reporter_fid", T.LongType(), False),
        T.StructField("target_fid", T.LongType(), False),
        T.StructField("cast_hash", T.StringType()),
        T.StructField("message_hash", T.StringType()),
        T.StructField("network", T.IntegerType()),
        T.StructField("reported_as_sybil", T.BooleanType()),
        T.StructField("sybil_probability", T.FloatType()),
        T.StructField("attestation", T.StringType()),
        T.StructField("report_timestamp", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def add_reports(new: DataFrame, out: str) -> None:
    """Store reports by id in the table ``reports`` of a folder; a report delivered again replaces its earlier row."""
    validate(new, REPORTS.names, {f.name: f.dataType for f in REPORTS.fields})
    upsert(new.where("id IS NOT NULL").select(*REPORTS.names), f"{out}/reports", "id")


@dataclass(frozen=True)
class JobConfig:
    """Where the job writes and how it combines its two scores."""

    out: str
    combine: str = "min"
    rounds: int = 10
    learners: tuple[str, ...] = ("gbt", "forest", "logistic")
    model: ModelConfig = field(default_factory=lambda: ModelConfig(label="label"))


def published(graph: DataFrame, model: DataFrame, names: DataFrame, how: str = "min") -> DataFrame:
    """Rows of SCORES from (fid, graph_score), (fid, model_score) and (fid, fname).

    Every account that has a name or a score has a row; without a name fname is null.
    """
    j = names.where("fid IS NOT NULL").join(graph.join(model, "fid", "full"), "fid", "full")
    c = combine(j, "graph_score", "model_score", how)
    return c.select(F.col("fid").cast("bigint").alias("fid"), "fname", F.col("score").cast("float").alias("sybil_probability"), F.col("diagnosis").alias("sybil_diagnosis"), F.current_timestamp().alias("last_updated"))


def run_job(config: JobConfig, links: DataFrame, labels: DataFrame, features: DataFrame, names: DataFrame, upto: int) -> Ensemble:
    """Propagate trust, fit and apply the ensemble, publish scores by key, leave a marker. Errors are not caught.

    ``links`` (fid, target_fid) are live follows, ``labels`` (fid, bot), ``features`` one row per account.
    """
    validate(links, ["fid", "target_fid"])
    validate(labels, ["fid", "bot"])
    scar = sybil_scar(symmetric(mutual_pairs(links)), labels, config.rounds)
    graph = scar.select(F.col("id").alias("fid"), (1 - F.col("posterior")).alias("graph_score"))
    columns = [c for c in numeric_columns(features) if c != "fid"]
    matrix = clean_matrix(features, columns)
    train = matrix.join(labels.where("bot IS NOT NULL").select("fid", F.col("bot").cast("double").alias("label")), "fid")
    model = Ensemble(columns, config.model, config.learners).fit(train)
    scored = model.transform(matrix).select("fid", F.col("adjusted").alias("model_score"))
    os.makedirs(config.out, exist_ok=True) if "://" not in config.out else None
    upsert(published(graph, scored, names, config.combine), f"{config.out}/scores", "fid")
    model.save(f"{config.out}/model")
    write_marker(f"{config.out}/marker.json", upto)
    return model


def check_account(spark: SparkSession, out: str, fid: int | None = None, fname: str | None = None) -> dict[str, object]:
    """The published verdict on one account by number or name; a point look-up that prunes by the key's statistics."""
    t = spark.read.parquet(f"{out}/scores")
    row = t.where(F.col("fid") == fid if fid is not None else F.col("fname") == fname).orderBy("fid").first()
    if row is None or row["sybil_probability"] is None:
        return {"fid": row["fid"] if row else fid, "result": None, "numeric_result": None, "message": "no score for this account"}
    p = row["sybil_probability"]
    return {"fid": row["fid"], "result": "benign" if p < 0.5 else "sybil", "numeric_result": round(p, 4), "message": ""}


def predict_account(manager: FeatureManager, model: Ensemble, fid: int | None = None, fname: str | None = None, names: DataFrame | None = None) -> dict[str, object]:
    """Build the features of one account and score it: fid, status and probability.

    ``names`` (fid, fname) resolves a name and, where given, tells which accounts exist; status is ``not_found``
    without a match and ``feature_build_failed`` (with the missing columns) when the feature sets do not give
    what the model was fitted on. Features are put in the model's order; other features are not passed to it.
    """
    if names is not None:
        hit = names.where(F.col("fid") == fid if fid is not None else F.col("fname") == fname).agg(F.min("fid")).first()[0]
        if hit is None:
            return {"fid": fid, "status": "not_found", "probability": None}
        fid = hit
    missing = [c for c in model.columns if manager.registry.provider(c) is None]
    if missing:
        return {"fid": fid, "status": "feature_build_failed", "probability": None, "missing": missing}
    sets = list(dict.fromkeys(manager.registry.provider(c) for c in model.columns))
    row = manager.features_for([fid], sets).select("fid", *[F.col(c).cast("double").alias(c) for c in model.columns])
    got = model.transform(row).select("adjusted").first()
    return {"fid": fid, "status": "ok", "probability": float(got[0])} if got else {"fid": fid, "status": "not_found", "probability": None}


def purge(folder: str, keep: tuple[str, ...] = ()) -> list[str]:
    """Remove the entries of a local folder but those named; returns what was removed, nothing for a missing folder."""
    gone = []
    for f in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if f not in keep:
            p = os.path.join(folder, f)
            shutil.rmtree(p) if os.path.isdir(p) else os.remove(p)
            gone.append(f)
    return gone


def import_latest(spark: SparkSession, source: str, prefixes: list[str], target: str) -> dict[str, str]:
    """Copy, for each prefix, the newest file of ``source`` whose name starts with it to ``target``, unless it is there.

    Works on any file system the cluster knows; copies run on the driver, one stream per file.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    a, b = src.getFileSystem(conf), dst.getFileSystem(conf)
    files = [(f.getModificationTime(), f.getPath().getName(), f.getPath()) for f in a.listStatus(src)]
    out = {}
    for p in prefixes:
        found = max(((t, n, x) for t, n, x in files if n.startswith(p)), default=None, key=lambda f: f[:2])
        if found:
            to = jvm.org.apache.hadoop.fs.Path(dst, found[1])
            if not b.exists(to):
                jvm.org.apache.hadoop.fs.FileUtil.copy(a, found[2], b, to, False, conf)
            out[p] = to.toString()
    return out
