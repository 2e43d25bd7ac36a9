"""Relational building blocks that need more than one built-in, with a defined result for nulls and ties."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.safe import scalars


def keep(df: DataFrame, key: str, members: DataFrame, column: str | None = None) -> DataFrame:
    """Rows whose key is among ``members``; null is a member of nothing."""
    m = members.select(F.col(column or key).alias("m__")).distinct()
    return df.join(m, F.col(key) == F.col("m__"), "left_semi")


def without(df: DataFrame, key: str, members: DataFrame, column: str | None = None) -> DataFrame:
    """Rows whose key is not among ``members``; rows with a null key stay, nulls in ``members`` exclude nothing."""
    m = members.select(F.col(column or key).alias("m__")).distinct()
    return df.join(m, F.col(key) == F.col("m__"), "left_anti")


def replaced(column: str, mapping: Mapping[object, object], default: object | None = None) -> Column:
    """The value a mapping gives, or ``default``; for mappings small enough to be literals."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(default)) if pairs else F.lit(default)


def duplicated(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value occurs more than once; values are counted with partial aggregation, rows then join."""
    many = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("d__")).agg(F.count(F.lit(1)).alias("n__")).where("n__ > 1").select("d__")
    return df.join(many, F.col(column) == F.col("d__"), "left_semi")


def latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``, as one aggregate; ties go to the greatest row."""
    rest = [c for c in df.columns if c != key and c not in order]
    s = F.struct(*[F.col(c) for c in (*order, *rest)])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(s).alias("s__")).select(key, "s__.*").select(*df.columns)


def top_per_group(df: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark limits within map tasks before it shuffles."""
    return df.withColumn("r__", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r__") <= k).drop("r__")


def pivot_counts(df: DataFrame, key: str, column: str, values: Mapping[str, object]) -> DataFrame:
    """(key, <name> ...): how often each value occurs per key, null where it does not; one pass, no separate pivot."""
    return df.groupBy(key).agg(*[F.nullif(F.count(F.when(F.col(column) == v, 1)), F.lit(0).cast("bigint")).alias(n) for n, v in values.items()])


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, min, max): a row per numeric column from a single aggregate."""
    aggs = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max")).alias(c) for c in columns]
    return df.agg(*aggs).select(F.explode(F.array(*columns)).alias("x")).select("x.*")


def with_totals(df: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """``df`` with aggregates of its key's rows; null keys form one group.

    Aggregated with partial combining and joined back, so that few keys with many rows each cost no task more
    than another, unlike a window over the key.
    """
    t = df.groupBy(F.col(key).alias("t__")).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(t, F.col(key).eqNullSafe(F.col("t__")), "left").drop("t__")


def page(df: DataFrame, order: Sequence[str], offset: int, length: int) -> DataFrame:
    """Rows offset .. offset + length - 1 in a total order."""
    return df.orderBy(*order).offset(offset).limit(length)


def newer_than(df: DataFrame, ts: str, months: int) -> DataFrame:
    """Rows within so many months of the table's newest; the bound is a scalar subquery."""
    return df.where(F.col(ts) > scalars(df.agg(F.max(ts).alias("top")))("top") - F.make_interval(months=F.lit(months)))


def tokens_of_group(df: DataFrame, key: str, text: str, order: Sequence[str]) -> DataFrame:
    """(key, text): lower-cased texts of a key joined by spaces in a fixed order, for groups of bounded size."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.lower(text).alias("t__"))))
    return df.where(F.col(text).isNotNull()).groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["t__"]), " ").alias(text))
