"""Access to the parquet tables of one delivery folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """The table ``name`` of ``folder``, all columns unless named."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def records(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row per record of a table whose rows may be delivered again.

    Copies agree in ``columns`` (delivery columns such as created_at are left out by the caller), so this is a
    distinct over them, with partial aggregation before the shuffle; its cost is that of the columns asked for,
    texts included. Rows with a null id cannot be told apart and are kept once per distinct content.
    """
    return df.select(id_col, *[c for c in columns if c != id_col]).distinct()


def activity(casts: DataFrame, reactions: DataFrame) -> DataFrame:
    """(fid, kind, id, timestamp) of all casts and reactions with an account and a time, soft-deleted ones included.

    Rows delivered again are still in it.
    """
    cols = ("fid", "kind", "id", "timestamp")
    c = casts.where("fid IS NOT NULL AND timestamp IS NOT NULL").withColumn("kind", F.lit(1))
    r = reactions.where("fid IS NOT NULL AND timestamp IS NOT NULL").withColumn("kind", F.lit(2))
    return c.select(*cols).unionAll(r.select(*cols))
