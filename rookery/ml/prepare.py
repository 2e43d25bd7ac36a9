"""Preparation of a feature matrix and deterministic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.safe import clip, is_infinite, scalars
from rookery.sources.datasets import numeric_columns


def clean_matrix(df: DataFrame, columns: Sequence[str], bound: float = 1e9) -> DataFrame:
    """Infinities become null, nulls (and NaN) the column's median, values are clipped to +-``bound``.

    All medians come from one aggregate; a column without values becomes 0.
    """
    x = df.withColumns({c: F.when(~is_infinite(c) & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns})
    m = scalars(x.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns]))
    return x.select(*[f for f in df.columns if f not in columns], *[clip(F.coalesce(F.col(c), m(c), F.lit(0.0)), -bound, bound).alias(c) for c in columns])


def winsorize(df: DataFrame, columns: Sequence[str], lo: float = 0.01, hi: float = 0.99, sigmas: float = 3.0) -> DataFrame:
    """Clip each column to the tighter of its percentiles and its mean +- sigmas; one aggregate, one projection."""
    s = []
    for c in columns:
        s += [F.percentile(c, F.lit(lo)).alias(f"lo_{c}"), F.percentile(c, F.lit(hi)).alias(f"hi_{c}"), F.avg(c).alias(f"mu_{c}"), F.stddev_samp(c).alias(f"sd_{c}")]
    v = scalars(df.agg(*s))
    low = lambda c: F.greatest(v(f"lo_{c}"), v(f"mu_{c}") - sigmas * v(f"sd_{c}"))
    high = lambda c: F.least(v(f"hi_{c}"), v(f"mu_{c}") + sigmas * v(f"sd_{c}"))
    return df.select(*[f for f in df.columns if f not in columns], *[F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), high(c)), low(c))).alias(c) for c in columns])


def bad_rows(df: DataFrame, key: str) -> DataFrame:
    """Keys of rows with an infinity in any numeric column."""
    p = F.lit(False)
    for c in numeric_columns(df):
        p = p | is_infinite(c)
    return df.where(p).select(key)


def check_non_negative(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` itself, or an error that names the numeric columns with a negative value; null and NaN are none. One aggregate."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if columns:
        low = df.agg(*[F.min(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        bad = [c for i, c in enumerate(columns) if low[i] is not None and low[i] < 0]
        if bad:
            raise ValueError(f"negative values in {', '.join(bad)}")
    return df


def check_matrix(df: DataFrame, label: str, columns: Sequence[str], large: float = 1e6) -> dict[str, object]:
    """Class counts and the columns with extreme values; raises on NaN or infinities."""
    a = df.agg(
        *[F.max((is_infinite(c) | F.isnan(F.col(c).cast("double"))).cast("int")).alias(f"bad_{c}") for c in columns],
        *[F.max(F.abs(c)).alias(f"top_{c}") for c in columns],
        F.sum(F.col(label).cast("int")).alias("positive"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    bad = [c for c in columns if a[f"bad_{c}"]]
    if bad:
        raise ValueError(f"NaN or infinite values in {', '.join(bad)}")
    return {"positive": a["positive"] or 0, "n": a["n"], "large": [c for c in columns if (a[f"top_{c}"] or 0) > large]}


def split_key(key: str, seed: int = 0) -> object:
    """A pseudo-random number in [0, 2^32) that depends on a whole-numbered key alone."""
    return F.pmod(F.col(key) * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))


def holdout(df: DataFrame, key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """``df`` with is_test: a fixed pseudo-random share of each class, as each row is drawn by its own key. No shuffle."""
    return df.withColumn("is_test", split_key(key, seed) < F.lit(int(share * 4294967296)))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with fold in [0, k), drawn by key."""
    return df.withColumn("fold", F.expr(f"CAST((pmod(`{key}` * 2654435761L + {seed}, 4294967296) * {k}) div 4294967296 AS INT)"))


def sample_n(df: DataFrame, key: str, n: int, by: str | None = None, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (per value of ``by``), the first in a pseudo-random order of the key."""
    order = (split_key(key, seed), F.col(key))
    if by is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("r__", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("r__") <= n).drop("r__")


def anomaly_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with anomaly: the mean robust z-score over the columns (distance from the median in median deviations).

    Stands in for an isolation forest: one aggregate for medians, one for deviations, then arithmetic.
    """
    m = scalars(df.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns]))
    d = scalars(df.agg(*[F.percentile(F.abs(F.col(c) - m(c)), F.lit(0.5)).alias(c) for c in columns]))
    z = F.lit(0.0)
    for c in columns:
        z = z + F.coalesce(F.abs(F.col(c) - m(c)) / (1.4826 * d(c) + 1e-9), F.lit(0.0))
    return df.withColumn("anomaly", z / len(columns))


def label_samples(df: DataFrame, key: str, columns: Sequence[str], segment: str, n: int, anomalous: float = 0.25) -> DataFrame:
    """Rows to label: per segment up to ``n``, at most a share of them the most anomalous, the rest pseudo-random."""
    a = anomaly_scores(df, columns)
    k = int(n * anomalous)
    # both ranks are cut off by a filter, which Spark applies inside the map tasks: no segment is gathered
    by_score = Window.partitionBy(segment).orderBy(F.desc("anomaly"), key)
    top = a.withColumn("r__", F.row_number().over(by_score)).where(F.col("r__") <= k).drop("r__")
    rest = a.join(top.select(key), key, "left_anti")
    drawn = Window.partitionBy(segment).orderBy(split_key(key), key)
    others = rest.withColumn("r__", F.row_number().over(drawn)).where(F.col("r__") <= n - k).drop("r__")
    return top.withColumn("is_anomaly", F.lit(True)).unionByName(others.withColumn("is_anomaly", F.lit(False)))
