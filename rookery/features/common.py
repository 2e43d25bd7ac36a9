"""What every group of features shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finish(df: DataFrame, key: str = "fid", digits: int | None = 6) -> DataFrame:
    """Key as bigint, null features 0, fractions rounded; one row per key is the caller's grouping.

    Fractions are rounded to ten digits first, so that the order of a sum cannot decide a half.
    """
    out = [F.col(key).cast("bigint").alias(key)]
    for f in df.schema.fields:
        if f.name == key:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = c.cast("double")
            c = F.coalesce(F.round(F.round(c, 10), digits) if digits is not None else c, F.lit(0.0))
        elif isinstance(f.dataType, T.NumericType):
            c = F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
        out.append(c.alias(f.name))
    return df.select(*out)


def left_joined(spine: DataFrame, groups: Sequence[DataFrame], key: str = "fid") -> DataFrame:
    """Feature groups on the spine; a column that an earlier group owns is not taken again."""
    out = spine
    for g in groups:
        out = out.join(g.select(key, *[c for c in g.columns if c != key and c not in out.columns]), key, "left")
    return out


def histogram_of(value: Column, values: range) -> Column:
    """Aggregate: array of the number of rows per value, one conditional count each, in one pass."""
    return F.array(*[F.count(F.when(value == v, 1)) for v in values])


def array_sum(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)


def array_entropy(a: Column | str) -> Column:
    """Entropy in bits of an array of counts; null when all are 0."""
    total = F.nullif(array_sum(a), F.lit(0).cast("bigint")).cast("double")
    return F.when(total.isNotNull(), F.aggregate(a, F.lit(0.0), lambda s, x: s + F.when(x > 0, -(x / total) * F.log2(x / total)).otherwise(0.0)))


def array_distinct_count(a: Column | str) -> Column:
    return F.size(F.filter(a, lambda x: x > 0)).cast("bigint")


def array_std(a: Column | str) -> Column:
    """Sample standard deviation of the positive counts in an array; null for fewer than two."""
    pos = F.filter(a, lambda x: x > 0)
    n = F.size(pos)
    mean = array_sum(a).cast("double") / F.nullif(n, F.lit(0))
    ss = F.aggregate(pos, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(ss / F.nullif(n - 1, F.lit(0))))
