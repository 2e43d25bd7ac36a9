"""From model probabilities to scores, diagnoses and segments, as column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.safe import clip, count_if, scalars, sdiv


def mean_of(cols: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for c in cols:
        out = out + c
    return out / len(cols)


def spread_of(cols: Sequence[Column]) -> Column:
    """Population standard deviation across columns."""
    m = mean_of(cols)
    return F.sqrt(mean_of([(c - m) * (c - m) for c in cols]))


def soft_vote(df: DataFrame, probabilities: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """``df`` with vote, adjusted and confidence.

    ``vote`` is the (weighted) mean; ``adjusted`` draws it to one half as the models disagree; ``confidence``
    grows with distance from one half and with agreement, within [0, 1].
    """
    p = [F.col(c).cast("double") for c in probabilities]
    if weights:
        total = float(sum(weights))
        vote = F.lit(0.0)
        for c, w in zip(p, weights):
            vote = vote + c * (w / total)
    else:
        vote = mean_of(p)
    sd = spread_of(p)
    agree = 1 - clip(sd, 0.0, 0.5)
    return df.withColumns({"vote": vote, "adjusted": mean_of(p) * agree + 0.5 * (1 - agree), "confidence": clip((2 * F.abs(mean_of(p) - 0.5) + 1 - sd) / 2, 0.0, 1.0)})


def combine(df: DataFrame, a: str, b: str, how: str = "mean", hi: float = 0.8, lo: float = 0.2) -> DataFrame:
    """``df`` with score and diagnosis from two scores of which either may be null.

    One null leaves the other; ``how`` is mean or min. The diagnosis is true above ``hi``, false up to ``lo``
    and null between or without a score.
    """
    if how not in ("mean", "min"):
        raise ValueError("how is mean or min")
    x, y = F.col(a), F.col(b)
    both = (x + y) / 2 if how == "mean" else F.least(x, y)
    score = F.when(x.isNotNull() & y.isNotNull(), both).otherwise(F.coalesce(x, y))
    out = df.withColumn("score", score)
    return out.withColumn("diagnosis", F.when(F.col("score") > hi, True).when(F.col("score") <= lo, False))


def decision(df: DataFrame, score: str) -> DataFrame:
    """``df`` with verdict: benign below one half, else sybil, and the score with four decimals."""
    return df.withColumns({"verdict": F.when(F.col(score) < 0.5, "benign").when(F.col(score).isNotNull(), "sybil"), "rounded": F.round(score, 4)})


def segment_of(casts: Column, replies: Column) -> Column:
    """Segment of an account by its activity; null between the named ones."""
    return F.when((casts >= 20) & (replies >= 5), "power").when((casts >= 5) & (casts < 20), "casual").when(casts == 0, "lurker").when((casts > 0) & (casts < 5), "one_time")


def segments(df: DataFrame, casts: str, replies: str, label: str) -> DataFrame:
    """(segment, n, share, bot_rate, avg_casts) over accounts that fall into a segment; shares are of all rows."""
    t = df.withColumn("segment", segment_of(F.col(casts), F.col(replies)))
    a = t.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("int")).alias("bot_rate"), F.avg(casts).alias("avg_casts"), count_if(F.col(label).isNotNull()).alias("n_labelled"))
    total = scalars(a.agg(F.sum("n").alias("t")))("t")
    return a.where("segment IS NOT NULL").select("segment", "n", sdiv("n", total).alias("share"), "bot_rate", "avg_casts", "n_labelled", sdiv("n_labelled", "n").alias("coverage"))


def priority(df: DataFrame, key: str, columns: Sequence[str], k: int, among: DataFrame | None = None) -> DataFrame:
    """The ``k`` keys with the greatest sum of columns, each divided by its maximum; ties by key.

    Keys of ``among`` are done already: they count in the maxima and are left out of the list. A top-k that
    every task shortens to ``k`` rows before it sends them.
    """
    tops = scalars(df.agg(*[F.max(F.abs(c)).alias(c) for c in columns]))
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(sdiv(c, tops(c)), F.lit(0.0))
    ranked = df.select(key, total.alias("priority"))
    if among is not None:
        ranked = ranked.join(among.select(key), key, "left_anti")
    return ranked.orderBy(F.desc("priority"), key).limit(k)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bucket, n) of a probability in equal bins; 1 falls into the last, null and NaN are left out."""
    x = F.col(column)
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def population(df: DataFrame, column: str, threshold: float = 0.5) -> DataFrame:
    """One row about the scores of a population: how many on either side of a threshold, mean, median, deviation and range.

    The median is an order statistic within 1 / 10,000 of the middle rank; null and NaN are left out.
    """
    x = F.col(column).cast("double")
    live = df.where(x.isNotNull() & ~F.isnan(x))
    return live.agg(
        F.count(F.lit(1)).alias("n"), count_if(x >= threshold).alias("n_above"), count_if(x < threshold).alias("n_below"), F.avg(x).alias("mean"), F.percentile_approx(x, 0.5, 10_000).alias("median"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")
    )


def interval(df: DataFrame, probabilities: Sequence[str], z: float = 1.959964) -> DataFrame:
    """``df`` with lower, upper and a category of confidence from the spread of several models."""
    p = [F.col(c).cast("double") for c in probabilities]
    m, sd = mean_of(p), spread_of(p)
    width = 2 * z * sd
    return df.withColumns({"lower": clip(m - z * sd, 0.0, 1.0), "upper": clip(m + z * sd, 0.0, 1.0), "category": F.when(width < 0.2, "high").when(width < 0.5, "medium").otherwise("low")})


def problems(df: DataFrame, probability: str, confidence: str, label: str) -> DataFrame:
    """``df`` with flags, an array of what is doubtful about each prediction."""
    p, c, y = F.col(probability), F.col(confidence), F.col(label).cast("int")
    named = F.array(
        F.when(p.between(0.4, 0.6), "uncertain"),
        F.when((p >= 0.5) & (y == 0), "false_alarm"),
        F.when((p < 0.5) & (y == 1), "missed"),
        F.when((c > 0.8) & ((p >= 0.5) != (y == 1)), "confident_error"),
    )
    return df.withColumn("flags", F.array_compact(named))
