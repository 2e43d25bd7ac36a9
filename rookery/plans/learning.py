"""Queries for preparation, scoring, evaluation, segmentation and models.

The scores they work on are shares of an account's activity: of likes among its reactions, of replies and of
channel posts among its casts. The label is the one of :func:`rookery.sources.views.labels`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.safe import count_if, sdiv
from rookery.ml import metrics as M
from rookery.ml import models
from rookery.ml import prepare as P
from rookery.ml import scoring as S
from rookery.plans.registry import Registry
from rookery.session import cut
from rookery.sources import views as V

R = Registry()

_SCORES = """sc AS (SELECT fid, a.p1, b.p2, b.p3, coalesce(b.casts, 0) AS casts, coalesce(b.replies, 0) AS replies, coalesce(a.reacts, 0) AS reacts FROM
  (SELECT fid, count(*) FILTER (reaction_type = 1) / count(*) AS p1, count(*) AS reacts FROM r GROUP BY fid) a
  FULL JOIN (SELECT fid, count(parent_hash) / count(*) AS p2, count(parent_url) / count(*) AS p3, count(*) AS casts, count(parent_hash) AS replies FROM c GROUP BY fid) b USING (fid))"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    a = V.reactions(spark, d, ["fid", "reaction_type"]).groupBy("fid").agg(sdiv(count_if(F.col("reaction_type") == 1), F.count(F.lit(1))).alias("p1"), F.count(F.lit(1)).alias("reacts"))
    n = F.count(F.lit(1))
    b = V.casts(spark, d, ["fid", "parent_hash", "parent_url"]).groupBy("fid").agg(
        sdiv(F.count("parent_hash"), n).alias("p2"), sdiv(F.count("parent_url"), n).alias("p3"), n.alias("casts"), F.count("parent_hash").alias("replies")
    )
    return a.join(b, "fid", "full").na.fill(0, ["casts", "replies", "reacts"])


def _sql(body: str, more: str = "") -> str:
    return V.with_views("c r lb", body, _SCORES + (", " + more if more else ""))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).join(V.labels(spark, d), "fid")


def _complete(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("p1 IS NOT NULL AND p2 IS NOT NULL")


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@R.add(_sql("SELECT round((sum(rk) FILTER (bot) - count(*) FILTER (bot) * (count(*) FILTER (bot) + 1) / 2) / (count(*) FILTER (bot) * count(*) FILTER (NOT bot)), 6) AS auc FROM (SELECT bot, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2.0 AS rk FROM sc JOIN lb USING (fid) WHERE p1 IS NOT NULL)"))
def auc_exact(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.roc_auc(_labelled(spark, d), "p1", "bot"), "auc")


_CONF = "k AS (SELECT count(*) FILTER (NOT bot AND p1 < 0.5)::DOUBLE AS tn, count(*) FILTER (NOT bot AND p1 >= 0.5)::DOUBLE AS fp, count(*) FILTER (bot AND p1 < 0.5)::DOUBLE AS fn, count(*) FILTER (bot AND p1 >= 0.5)::DOUBLE AS tp FROM sc JOIN lb USING (fid))"


@R.add(_sql("""SELECT tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc,
round(((tp + tn) / n - e) / nullif(1 - e, 0), 6) AS kappa, round((tp + tn) / n, 6) AS accuracy FROM (SELECT *, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) AS e FROM (SELECT *, tn + fp + fn + tp AS n FROM k))""", _CONF))
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.confusion(_labelled(spark, d), "p1", "bot"), "precision", "recall", "f1", "mcc", "kappa", "accuracy")


@R.add(_sql("SELECT round(avg(CASE WHEN p1 = 0.5 THEN 0.5 WHEN (p1 > 0.5) <> bot THEN 1.0 ELSE 0.0 END), 6) AS error FROM sc JOIN lb USING (fid) WHERE p1 IS NOT NULL"))
def threshold_error(spark: SparkSession, d: str) -> DataFrame:
    return _round(M.threshold_error(_labelled(spark, d), "p1", "bot", 0.5), "error")


@R.add(_sql("SELECT fid, bot, CASE WHEN p1 IS NULL THEN bot ELSE bot <> (p1 < 0.5) END AS is_noisy FROM lb LEFT JOIN sc USING (fid)"))
def noisy_labels(spark: SparkSession, d: str) -> DataFrame:
    return M.noisy_labels(V.labels(spark, d).join(_scores(spark, d), "fid", "left"), "p1", "bot").select("fid", "bot", "is_noisy")


_DIAG = "SELECT fid, round(score, 6) AS score, CASE WHEN score > 0.8 THEN true WHEN score <= 0.2 THEN false END AS diagnosis FROM (SELECT fid, CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN {both} ELSE coalesce(p1, p2) END AS score FROM sc)"


@R.add(_sql(_DIAG.format(both="(p1 + p2) / 2")))
def score_combine_mean(spark: SparkSession, d: str) -> DataFrame:
    return _round(S.combine(_scores(spark, d), "p1", "p2", "mean"), "score").select("fid", "score", "diagnosis")


@R.add(_sql(_DIAG.format(both="least(p1, p2)")))
def score_combine_min(spark: SparkSession, d: str) -> DataFrame:
    return _round(S.combine(_scores(spark, d), "p1", "p2", "min"), "score").select("fid", "score", "diagnosis")


@R.add(_sql("SELECT fid, CASE WHEN p1 < 0.5 THEN 'benign' WHEN p1 IS NOT NULL THEN 'sybil' END AS verdict, round(p1, 4) AS rounded FROM sc"))
def decision(spark: SparkSession, d: str) -> DataFrame:
    return S.decision(_scores(spark, d), "p1").select("fid", "verdict", "rounded")


_VOTE = "v AS (SELECT fid, bot, m, sd, 1 - greatest(least(sd, 0.5), 0) AS agree FROM (SELECT fid, bot, m, sqrt((pow(p1 - m, 2) + pow(p2 - m, 2) + pow(p3 - m, 2)) / 3) AS sd FROM (SELECT *, (p1 + p2 + p3) / 3 AS m FROM sc LEFT JOIN lb USING (fid) WHERE p1 IS NOT NULL AND p2 IS NOT NULL)))"


@R.add(_sql("SELECT fid, round(m, 6) AS vote, round(m * agree + 0.5 * (1 - agree), 6) AS adjusted, round(greatest(least((2 * abs(m - 0.5) + 1 - sd) / 2, 1), 0), 6) AS confidence FROM v", _VOTE))
def agreement_adjust(spark: SparkSession, d: str) -> DataFrame:
    return _round(S.soft_vote(_complete(spark, d), ["p1", "p2", "p3"]), "vote", "adjusted", "confidence").select("fid", "vote", "adjusted", "confidence")


@R.add(_sql("SELECT fid, round(greatest(least(m - 1.959964 * sd, 1), 0), 6) AS lower, round(greatest(least(m + 1.959964 * sd, 1), 0), 6) AS upper, CASE WHEN 2 * 1.959964 * sd < 0.2 THEN 'high' WHEN 2 * 1.959964 * sd < 0.5 THEN 'medium' ELSE 'low' END AS category FROM v", _VOTE))
def prediction_interval(spark: SparkSession, d: str) -> DataFrame:
    return _round(S.interval(_complete(spark, d), ["p1", "p2", "p3"]), "lower", "upper").select("fid", "lower", "upper", "category")


@R.add(_sql("SELECT f AS flag, count(*) AS n FROM (SELECT unnest([CASE WHEN m BETWEEN 0.4 AND 0.6 THEN 'uncertain' END, CASE WHEN m >= 0.5 AND NOT bot THEN 'false_alarm' END, CASE WHEN m < 0.5 AND bot THEN 'missed' END, CASE WHEN greatest(least((2 * abs(m - 0.5) + 1 - sd) / 2, 1), 0) > 0.8 AND (m >= 0.5) <> bot THEN 'confident_error' END]) AS f FROM v) WHERE f IS NOT NULL GROUP BY f", _VOTE))
def problem_flags(spark: SparkSession, d: str) -> DataFrame:
    v = S.soft_vote(_complete(spark, d), ["p1", "p2", "p3"]).join(V.labels(spark, d), "fid", "left")
    return S.problems(v, "vote", "confidence", "bot").select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


_SEG = "CASE WHEN casts >= 20 AND replies >= 5 THEN 'power' WHEN casts >= 5 AND casts < 20 THEN 'casual' WHEN casts = 0 THEN 'lurker' WHEN casts > 0 AND casts < 5 THEN 'one_time' END"


@R.add(_sql(f"SELECT segment, count(*) AS n, round(count(*) / (SELECT count(*) FROM sc), 6) AS share, round(avg(bot::INT), 6) AS bot_rate, round(avg(casts), 6) AS avg_casts, count(bot) AS n_labelled, round(count(bot) / count(*), 6) AS coverage FROM (SELECT *, {_SEG} AS segment FROM sc LEFT JOIN lb USING (fid)) WHERE segment IS NOT NULL GROUP BY segment"))
def segments(spark: SparkSession, d: str) -> DataFrame:
    x = _scores(spark, d).join(V.labels(spark, d), "fid", "left")
    return _round(S.segments(x, "casts", "replies", "bot"), "share", "bot_rate", "avg_casts", "coverage")


@R.add(_sql("SELECT fid, round(casts / (SELECT max(casts) FROM sc) + reacts / (SELECT max(reacts) FROM sc), 6) AS priority FROM sc WHERE fid NOT IN (SELECT fid FROM lb) ORDER BY casts / (SELECT max(casts) FROM sc) + reacts / (SELECT max(reacts) FROM sc) DESC, fid LIMIT 50"))
def priority_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 50 unlabelled accounts of most activity; maxima are those of all accounts."""
    x = S.priority(_scores(spark, d), "fid", ["casts", "reacts"], 50, among=V.labels(spark, d))
    return _round(x, "priority")


@R.add(_sql("SELECT least(floor(p1 * 10), 9)::INT AS bucket, count(*) AS n FROM sc WHERE p1 IS NOT NULL GROUP BY 1"))
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram(_scores(spark, d), "p1")


@R.add(_sql("SELECT fid, round(greatest(least(casts, hi), lo), 6) AS casts FROM sc, (SELECT greatest(quantile_cont(casts, 0.01), avg(casts) - 3 * stddev_samp(casts)) AS lo, least(quantile_cont(casts, 0.99), avg(casts) + 3 * stddev_samp(casts)) AS hi FROM sc)"))
def winsorize(spark: SparkSession, d: str) -> DataFrame:
    return _round(P.winsorize(_scores(spark, d).select("fid", "casts"), ["casts"]), "casts")


@R.add(_sql("SELECT fid, round(coalesce(p1, (SELECT median(p1) FROM sc)), 6) AS p1, round(coalesce(p2, (SELECT median(p2) FROM sc)), 6) AS p2 FROM sc"))
def median_impute(spark: SparkSession, d: str) -> DataFrame:
    return _round(P.clean_matrix(_scores(spark, d).select("fid", "p1", "p2"), ["p1", "p2"]), "p1", "p2")


@R.add(V.with_views("lb", "SELECT bot, (fid * 2654435761) % 4294967296 < 858993459 AS is_test, count(*) AS n FROM lb GROUP BY ALL"))
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return P.holdout(V.labels(spark, d), "fid", 0.2).groupBy("bot", "is_test").agg(F.count(F.lit(1)).alias("n"))


@R.add(V.with_views("lb", "SELECT fid, CAST((((fid * 2654435761) % 4294967296) * 5) // 4294967296 AS INT) AS fold FROM lb"))
def k_folds(spark: SparkSession, d: str) -> DataFrame:
    return P.folds(V.labels(spark, d), "fid", 5).select("fid", "fold")


@R.add(V.with_views("lb", "SELECT fid, bot FROM (SELECT *, row_number() OVER (PARTITION BY bot ORDER BY (fid * 2654435761) % 4294967296, fid) AS r FROM lb) WHERE r <= 100"))
def seed_sample(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_n(V.labels(spark, d), "fid", 100, by="bot").select("fid", "bot")


_ROBUST = "z AS (SELECT fid, (abs(casts - mc) / (1.4826 * (SELECT median(abs(casts - mc)) FROM md) + 1e-9) + abs(reacts - mr) / (1.4826 * (SELECT median(abs(reacts - mr)) FROM md) + 1e-9)) / 2 AS anomaly FROM md)"


@R.add(_sql("SELECT fid, round(anomaly, 4) AS anomaly FROM z", "md AS (SELECT fid, casts, reacts, (SELECT median(casts) FROM sc) AS mc, (SELECT median(reacts) FROM sc) AS mr FROM sc), " + _ROBUST))
def anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    return P.anomaly_scores(_scores(spark, d), ["casts", "reacts"]).select("fid", F.round("anomaly", 4).alias("anomaly"))


_LAB = f"""x AS (SELECT * FROM (SELECT fid, casts, reacts, {_SEG} AS segment FROM sc WHERE fid NOT IN (SELECT fid FROM lb)) WHERE segment IS NOT NULL),
md AS (SELECT fid, segment, casts, reacts, (SELECT median(casts) FROM x) AS mc, (SELECT median(reacts) FROM x) AS mr FROM x), {_ROBUST.replace("SELECT fid, (abs", "SELECT fid, segment, (abs")},
t AS (SELECT fid, segment FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY anomaly DESC, fid) AS r FROM z) WHERE r <= 12),
o AS (SELECT fid, segment FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY (fid * 2654435761) % 4294967296, fid) AS r FROM z WHERE fid NOT IN (SELECT fid FROM t)) WHERE r <= 38)"""


@R.add(_sql("SELECT fid, segment, true AS is_anomaly FROM t UNION ALL SELECT fid, segment, false FROM o", _LAB))
def label_samples(spark: SparkSession, d: str) -> DataFrame:
    """Accounts to label next: per segment up to 50, a quarter of them anomalous."""
    x = _scores(spark, d).withColumn("segment", S.segment_of(F.col("casts"), F.col("replies"))).where("segment IS NOT NULL").join(V.labels(spark, d), "fid", "left_anti")
    return P.label_samples(x, "fid", ["casts", "reacts"], "segment", 50).select("fid", "segment", "is_anomaly")


_COLUMNS = ["p1", "p2", "p3", "casts", "replies", "reacts"]


def _training(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # the scores are written: medians, both results and every pass over them read events again otherwise
    x = P.clean_matrix(cut(_scores(spark, d), "scores"), _COLUMNS).join(V.labels(spark, d), "fid", "left").withColumn("label", F.col("bot").cast("double")).drop("bot")
    return x.where("label IS NOT NULL"), x.where("label IS NULL").drop("label")


def _one(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        have, _ = _training(spark, d)
        c = models.ModelConfig()
        parts = P.holdout(have, "fid", 0.2)
        m = models.pipeline(name, _COLUMNS, c).fit(models.with_weights(parts.where("NOT is_test"), c))
        return models.probability(m.transform(parts.where("is_test")), "p").select("fid", "label", "p")

    run.__doc__ = f"Held-out probabilities of the learner {name}."
    return run


def ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated soft vote of three learners, fitted on all labelled accounts, for the others."""
    have, rest = _training(spark, d)
    return models.Ensemble(_COLUMNS).fit(have).transform(rest).select("fid", "vote", "adjusted", "confidence")


def self_training(spark: SparkSession, d: str) -> DataFrame:
    """Labelled accounts after confident predictions have joined them."""
    have, rest = _training(spark, d)
    return models.self_training(have, rest, _COLUMNS, models.ModelConfig())[1].select("fid", "label")


def kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Size and mean activity of clusters of accounts."""
    x = models.clusters(P.clean_matrix(_scores(spark, d), _COLUMNS), _COLUMNS, 4)
    return x.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("casts").alias("avg_casts"))


@R.add(_sql("SELECT 'held out' AS part, count(*) AS n, true AS in_range FROM sc JOIN lb USING (fid) WHERE bot IS NOT NULL AND (fid * 2654435761) % 4294967296 < 858993459 UNION ALL SELECT 'clusters', count(*), true FROM sc"))
def model_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any model: every held-out account has a probability, every account a cluster."""
    p = _one("logistic")(spark, d).agg(F.lit("held out").alias("part"), F.count(F.lit(1)).alias("n"), F.min(F.col("p").between(0, 1)).alias("in_range"))
    k = kmeans(spark, d).agg(F.lit("clusters").alias("part"), F.sum("n").alias("n"), (F.min("cluster") >= 0).alias("in_range"))
    return p.unionAll(k)


for _f in (ensemble, self_training, kmeans):
    R.queries[_f.__name__] = _f
for _n in ("gbt", "forest", "logistic"):
    R.queries[f"model_{_n}"] = _one(_n)
QUERIES, ORACLE = R.queries, R.oracle
