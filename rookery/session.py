"""Session factory and the one place where intermediate tables are written."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}
_tables: list[str] = []


def get_session(app: str = "rookery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is designed for; ``conf`` overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: ``spark.checkpoint.dir`` of the session, or the context's checkpoint folder.

    Only where the cluster names none (tests in local mode) a local folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _made:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _made[app] = "file://" + tempfile.mkdtemp(prefix="rookery-")
        atexit.register(_remove, spark, _made[app])
    return _made[app]


def release(spark: SparkSession, keep: int = 0) -> int:
    """Remove the tables written by :func:`cut` but the first ``keep``; returns how many there are left.

    To be called once the results that read them have been consumed, so that a long session does not fill the
    shared folder: ``n = release(spark, len_before)`` around a query frees just that query's tables.
    """
    while len(_tables) > keep:
        _remove(spark, _tables.pop())
    return len(_tables)


def cut_tables() -> int:
    """How many tables :func:`cut` has written and not removed."""
    return len(_tables)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone by now; the folder is a scratch folder
        pass


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage in Python and the JVM.

    Shuffle files, broadcasts and compiled code of plans that have run are freed no sooner than that; to be called
    between the plans of a query that has many.
    """
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage and survives the loss of executors; the table is removed by :func:`release`, at the latest when
    the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rookery-{name}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(release, spark)
    df.write.option("compression", "zstd").parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)
