"""Resolution and loading of delivered data sets, and readers and writers of the exchange formats."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Key lists up to this length become literals of the scan's filter; longer ones a semi join.
MAX_LITERALS = 1000


class DatasetCatalog:
    """Data sets stored as ``<source>-<name>-0-<end>.parquet`` in one folder; the newest delivery is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str, source: str = "export") -> str:
        """The delivery with the greatest end number (compared as a number, not as text)."""
        pattern = re.compile(rf"{re.escape(source)}-{re.escape(name)}-0-(\d+)\.parquet")
        found = [(int(m[1]), f) for f in self._list() if (m := pattern.fullmatch(f))]
        if not found:
            raise FileNotFoundError(f"no delivery of {source}-{name} in {self.folder}")
        return f"{self.folder}/{max(found)[1]}"

    def _list(self) -> list[str]:
        if "://" not in self.folder:
            return os.listdir(self.folder)
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(p)]

    def load(self, name: str, source: str = "export", columns: Sequence[str] | None = None, fids: DataFrame | Iterable[int] | None = None, key: str = "fid") -> DataFrame:
        """Lazy scan; ``columns`` (None: all) always include the key, ``fids`` restricts it. Null keys are dropped then.

        A short list of keys is pushed into the scan, a long one or a DataFrame becomes a semi join whose
        strategy the optimiser chooses from its size.
        """
        df = self.spark.read.parquet(self.path(name, source))
        if columns is not None:
            df = df.select(key, *[c for c in columns if c != key])
        if fids is None:
            return df
        df = df.where(F.col(key).isNotNull())
        if not isinstance(fids, DataFrame):
            keys = sorted({int(f) for f in fids})
            if len(keys) <= MAX_LITERALS:
                return df.where(F.col(key).isin(keys))
            fids = self.spark.createDataFrame([(k,) for k in keys], f"`{key}` bigint")
        return df.join(fids.select(key).distinct(), key, "left_semi")

    def columns(self, name: str, source: str = "export") -> list[str]:
        """Column names from the file's footer."""
        return self.spark.read.parquet(self.path(name, source)).columns


def validate(df: DataFrame, required: Sequence[str], types: dict[str, T.DataType] | None = None) -> DataFrame:
    """``df`` itself, or an error that names missing columns and columns of another type."""
    missing = [c for c in required if c not in df.columns]
    wrong = [f"{c}: {df.schema[c].dataType.simpleString()}, not {t.simpleString()}" for c, t in (types or {}).items() if c in df.columns and df.schema[c].dataType != t]
    if missing or wrong:
        raise ValueError("; ".join([f"missing columns: {', '.join(missing)}"] * bool(missing) + wrong))
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add missing columns with their default and fill nulls of the others with it (NaN stays)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def scrub(df: DataFrame, drop: Sequence[str] = ("id",)) -> DataFrame:
    """Drop columns that later steps cannot read (extension types arrive as binary or null types) and ``drop``."""
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    return df.drop(*void, *drop)


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; missing columns are null, numbers of different types meet in the wider type."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) from lines ``u v [w]``; a missing weight is null, blank lines are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return t.select(F.get(p, F.lit(0)).cast("bigint").alias("src"), F.get(p, F.lit(1)).cast("bigint").alias("dst"), F.get(p, F.lit(2)).cast("double").alias("weight"))


def write_edges(edges: DataFrame, path: str) -> None:
    """Lines ``src dst``."""
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(id, positive) from a file whose first line lists positive and whose second negative ids."""
    lines = [r[0] for r in spark.read.text(path, wholetext=True).collect()]
    if len(lines) != 1:
        raise ValueError("a seed file is one file")
    rows = [(int(x), i == 0) for i, line in enumerate((lines[0].split("\n") + [""])[:2]) for x in line.split()]
    return spark.createDataFrame(rows, "id bigint, positive boolean")


def write_posteriors(df: DataFrame, path: str, key: str = "id", value: str = "posterior") -> None:
    """Lines ``id posterior`` with ten decimals."""
    df.select(F.format_string("%d %.10f", key, value).alias("value")).write.mode("overwrite").text(path)


def upsert(new: DataFrame, path: str, key: str) -> None:
    """Replace the rows of a parquet table whose keys occur in ``new``, keep the others; a new table if there is none.

    Written beside the table and swapped by two renames: a reader never sees a half-written table, but between the
    renames there is none for a moment. If the job dies there, the next call finds the old table and restores it.
    """
    spark = new.sparkSession
    jvm = spark._jvm
    at, side, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".new", path + ".old"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(side, True)
    if fs.exists(old) and not fs.exists(at):
        fs.rename(old, at)
    out = new
    if fs.exists(at):
        kept = spark.read.parquet(path).join(new.select(key).distinct(), key, "left_anti")
        out = kept.unionByName(new)
    out.write.parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(side, at)
    fs.delete(old, True)


def write_marker(path: str, last_timestamp: int) -> None:
    """A checkpoint marker: the time up to which deliveries were processed. On any file system the cluster knows."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    f = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        f.write(json.dumps({"last_timestamp": last_timestamp}).encode())
    finally:
        f.close()


def read_marker(path: str) -> int | None:
    """The time of a marker, None where there is none."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))["last_timestamp"]


def spine(df: DataFrame, key: str, n: int | None = None, ensure: Iterable[int] = ()) -> DataFrame:
    """Distinct non-null keys: all, or the ``n`` smallest, and in any case those in ``ensure``."""
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key)).distinct()
    if n is not None:
        keys = keys.orderBy(key).limit(n)
    extra = [(int(k),) for k in ensure]
    return keys.unionAll(df.sparkSession.createDataFrame(extra, f"`{key}` bigint")).distinct() if extra else keys


def publish_jdbc(df: DataFrame, url: str, name: str, key: str, batch_rows: int = 30_000, partitions: int = 8, properties: dict[str, str] | None = None) -> None:
    """Replace the rows of a database table whose keys occur in ``df`` by those of ``df``; create the table if missing.

    Executors write a staging table in batches over at most ``partitions`` connections; the exchange of rows
    is one transaction, so readers see the old or the new rows and a failed job leaves the table as it was.
    """
    spark, props = df.sparkSession, dict(properties or {})
    staging = f"{name}_staging"
    df.coalesce(partitions).write.option("batchsize", batch_rows).mode("overwrite").jdbc(url, staging, properties=props)
    p = spark._jvm.java.util.Properties()
    for k, v in props.items():
        p.setProperty(k, v)
    c = spark._jvm.java.sql.DriverManager.getConnection(url, p)
    try:
        c.setAutoCommit(False)
        there = c.getMetaData().getTables(None, None, None, None)
        names = set()
        while there.next():
            names.add(there.getString("TABLE_NAME").lower())
        s = c.createStatement()
        cols = ", ".join(f'"{x}"' for x in df.columns)
        if name.lower() not in names:
            c.commit()
            df.limit(0).write.jdbc(url, name, properties=props)
        s.executeUpdate(f'DELETE FROM {name} WHERE "{key}" IN (SELECT "{key}" FROM {staging})')
        s.executeUpdate(f"INSERT INTO {name} ({cols}) SELECT {cols} FROM {staging}")
        s.executeUpdate(f"DROP TABLE {staging}")
        c.commit()
    except Exception:
        c.rollback()
        raise
    finally:
        c.close()
