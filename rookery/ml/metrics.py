"""Evaluation of scores against labels, exactly and in aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.safe import count_if, scalars, sdiv


def checked(df: DataFrame, score: str, label: str) -> DataFrame:
    """``df`` itself, or an error: no rows, a null or NaN, a label other than 0 and 1, or a score outside [0, 1]. One aggregate."""
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    a = df.agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(s.isNull() | y.isNull() | F.isnan(s) | F.isnan(y)).alias("missing"),
        count_if(y.isNotNull() & ~y.isin(0.0, 1.0)).alias("labels"),
        count_if((s < 0) | (s > 1)).alias("scores"),
    ).first()
    wrong = [m for m, bad in (("no rows", a["rows"] == 0), (f"{a['missing']} rows without a score or label", a["missing"]), (f"{a['labels']} labels that are not 0 or 1", a["labels"]), (f"{a['scores']} scores outside [0, 1]", a["scores"])) if bad]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row, auc: the exact Mann-Whitney statistic with tied scores at their average rank.

    Rows are counted per distinct score first. Ranks need a running count over scores in order; it runs
    inside ranges of scores (a range partitioning on the score) with offsets from the ranges' totals, so no
    task sees all scores. Null scores and labels are left out; null when a class is missing.
    """
    bins = 1024
    y = F.col(label).cast("int")
    c = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"))
    edge = scalars(c.agg(F.min("s").alias("lo"), F.max("s").alias("hi")))
    c = c.withColumn("b", F.least(F.floor(F.coalesce(sdiv(F.col("s") - edge("lo"), edge("hi") - edge("lo")), F.lit(0.0)) * bins), F.lit(bins - 1)))
    below = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("within", F.coalesce(F.sum("q").over(below), F.lit(0)))
    per = c.groupBy("b").agg(F.sum("p").alias("bp"), F.sum("q").alias("bq"), F.sum(F.col("p") * (F.col("within") + F.col("q") / 2.0)).alias("won"))
    per = per.withColumn("before", F.coalesce(F.sum("bq").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most ``bins`` rows
    t = per.agg(F.sum(F.col("won") + F.col("bp") * F.col("before")).alias("won"), F.sum("bp").alias("P"), F.sum("bq").alias("N"))
    return t.select(sdiv("won", F.col("P").cast("double") * F.col("N")).alias("auc"))


def confusion(df: DataFrame, probability: str, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: tn, fp, fn, tp and precision, recall, f1, mcc, kappa and accuracy at a threshold."""
    y, z = F.col(label).cast("int") == 1, F.col(probability) >= threshold
    c = df.where(F.col(label).isNotNull() & F.col(probability).isNotNull()).agg(count_if(~y & ~z).alias("tn"), count_if(~y & z).alias("fp"), count_if(y & ~z).alias("fn"), count_if(y & z).alias("tp"))
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    by_chance = sdiv((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return c.select(
        "tn", "fp", "fn", "tp",
        sdiv(tp, tp + fp).alias("precision"),
        sdiv(tp, tp + fn).alias("recall"),
        sdiv(2 * tp, 2 * tp + fp + fn).alias("f1"),
        sdiv(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        sdiv(sdiv(tp + tn, n) - by_chance, 1 - by_chance).alias("kappa"),
        sdiv(tp + tn, n).alias("accuracy"),
    )


def threshold_error(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row, error: the share misjudged at a threshold, scores equal to it counting half."""
    y = F.col(label).cast("int")
    wrong = F.when(F.col(score) == threshold, 0.5).when((F.col(score) > threshold) != (y == 1), 1.0).otherwise(0.0)
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(F.avg(wrong).alias("error"))


def noisy_labels(df: DataFrame, posterior: str, label: str) -> DataFrame:
    """``df`` with is_noisy: the label contradicts the posterior; without a posterior, bot labels are noisy."""
    return df.withColumn("is_noisy", F.when(F.col(posterior).isNull(), F.col(label)).otherwise(F.col(label) != (F.col(posterior) < 0.5)))


def report(rows: DataFrame) -> str:
    """Names and values of a one-row result as lines of text."""
    r = rows.first()
    return "\n".join(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in r.asDict().items())
