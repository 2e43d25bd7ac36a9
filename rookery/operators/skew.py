"""Groups too large for one task: found by counting, bounded in number, and divided."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.safe import scalars

#: Rows of one group that a task is expected to take at once; groups with more are divided.
ROWS_PER_TASK = 100_000
#: No more groups than this can be found hot, whatever the size of the data: it bounds what is broadcast.
MOST_HOT = 10_000
#: Inputs of at most so many bytes, as stored, are not searched for hot groups.
SMALL_BYTES = 8 << 20


#: The columns that :func:`time_chunks` adds.
CHUNK = ["span__", "part__"]


def hot_groups(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(keys, rows__, parts__): the groups of ``df`` with more rows than a task should take, and into how many parts to cut each.

    A group is hot beyond ``rows_per_task`` rows or a ``MOST_HOT``-th of all rows, whichever is more, and is cut
    into parts of that size; so there are at most ``MOST_HOT`` hot groups and twice as many parts. Counts
    combine on the map side. Null keys form groups like any other value.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows__"))
    total = scalars(counts.agg(F.sum("rows__").alias("n")))("n")
    most = F.greatest(F.lit(float(rows_per_task)), total.cast("double") / MOST_HOT)
    return counts.where(F.col("rows__") > most).withColumn("parts__", F.ceil(F.col("rows__") / most).cast("int"))


def with_parts(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """``df`` with parts__, the number of parts of its group; 1 for groups that are not hot. No shuffle: ``hot`` is bounded."""
    h = hot.select(*[F.col(k).alias(f"hot{i}__") for i, k in enumerate(keys)], "parts__")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"hot{i}__"))
    return df.join(F.broadcast(h), on, "left").drop(*[f"hot{i}__" for i in range(len(keys))]).withColumn("parts__", F.coalesce("parts__", F.lit(1)))


def fits_one_task(df: DataFrame, most_bytes: int = SMALL_BYTES) -> bool:
    """Whether the planner's estimate of the whole of ``df`` is what a single task takes: then no group of it is too large.

    Files are estimated by their stored size and the columns read, joins far too high; a wrong guess changes the
    plan and no result.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most_bytes


def time_chunks(df: DataFrame, key: str, ts: str, span: str = "month", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` with CHUNK, a calendar span and a part of it, which order an account's rows in time and divide busy accounts.

    Spans of a key with too many rows are cut where their rows, counted by the second, reach equal shares; a
    second is never cut. Only the bounds of hot spans (at most twice ``MOST_HOT``) are broadcast. Rows with a
    null time share the first chunk of their key. An input that fits one task is not counted first.
    """
    start = F.coalesce(F.date_trunc(span, F.col(ts)).cast("date"), F.lit("0001-01-01").cast("date"))
    x = df.withColumn("span__", start)
    if fits_one_task(x.select(key, ts)):
        return x.withColumn("part__", F.lit(0))
    keyed = x.select(F.col(key).alias("key__"), "span__", F.date_trunc("second", F.col(ts)).alias("sec__"))
    hot = hot_groups(keyed, ["key__", "span__"], rows_per_task)
    busy = keyed.join(F.broadcast(hot), ["key__", "span__"]).where("sec__ IS NOT NULL").groupBy("key__", "span__", "rows__", "parts__", "sec__").agg(F.count(F.lit(1)).alias("n__"))
    before = F.sum("n__").over(Window.partitionBy("key__", "span__").orderBy("sec__").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n__")
    cuts = busy.withColumn("part__", F.floor(before * F.col("parts__") / F.col("rows__"))).groupBy("key__", "span__", "part__").agg(F.min("sec__").alias("from__")).where("part__ > 0")
    bounds = cuts.groupBy(F.col("key__").alias("k__"), F.col("span__").alias("s__")).agg(F.collect_list("from__").alias("bounds__"))
    out = x.join(F.broadcast(bounds), (F.col(key) == F.col("k__")) & (F.col("span__") == F.col("s__")), "left")
    part = F.coalesce(F.size(F.filter("bounds__", lambda b: b <= F.col(ts))), F.lit(0))
    return out.withColumn("part__", part).drop("k__", "s__", "bounds__")
