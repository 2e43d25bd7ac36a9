"""Trust propagation on the mutual graph: synchronous rounds of join and aggregate.

Every round reads only the state of the round before, so results do not depend on order, partitioning or
retries. Edges are laid out by their message key once; vertex states are small next to them. Lineage is cut
by a written table every few rounds, so a lost executor costs at most those rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.safe import clip, sdiv
from rookery.session import cut


def priors(vertices: DataFrame, labels: DataFrame, benign: float, sybil: float, neutral: float) -> DataFrame:
    """(id, prior) from labels (fid, bot); where an account is labelled both ways it counts as a bot."""
    l = labels.where("bot IS NOT NULL").groupBy(F.col("fid").alias("id")).agg(F.max("bot").alias("bot"))
    prior = F.when(F.col("bot"), F.lit(sybil)).when(~F.col("bot"), F.lit(benign)).otherwise(F.lit(neutral))
    return vertices.select("id").distinct().join(l, "id", "left").select("id", prior.alias("prior"))


def propagate(vertices: DataFrame, edges: DataFrame, update: Callable[[Column, Column, Column], Column], rounds: int, cut_every: int = 2, hub_degree: int = 1_000_000) -> DataFrame:
    """Vertices (id, prior, post) after ``rounds`` of post = update(post, prior, sum of weighted neighbours' posts).

    ``edges`` is (src, dst, weight); dst receives weight * post(src). A vertex without edges receives 0. The
    edges of a vertex with more than ``hub_degree`` are laid out in slices of about that size, each of which
    meets a copy of the vertex's state; there are at most edges / hub_degree such vertices.
    """
    if rounds <= 0:
        return vertices
    stored = cut(edges.select("src", "dst", "weight"), "edges")
    hubs = stored.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_degree)
    hubs = cut(hubs.select(F.col("src").alias("hub"), F.ceil(F.col("n") / hub_degree).cast("int").alias("slices")), "hubs")
    slice_ = F.pmod(F.xxhash64("dst"), F.coalesce("slices", F.lit(1))).cast("int")
    # edges stay where their sender is: every round shuffles vertex states and partial sums only
    e = stored.join(F.broadcast(hubs), F.col("src") == F.col("hub"), "left").select("src", slice_.alias("slice"), "dst", "weight").repartition("src", "slice").persist()
    state = vertices
    try:
        for i in range(rounds):
            copies = F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)
            sender = state.join(F.broadcast(hubs), F.col("id") == F.col("hub"), "left").select(F.col("id").alias("src"), F.col("post").alias("x"), F.explode(copies).alias("slice"))
            sent = e.join(sender, ["src", "slice"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("weight") * F.col("x")).alias("got"))
            state = state.join(sent, "id", "left").select("id", "prior", update(F.col("post"), F.col("prior"), F.coalesce("got", F.lit(0.0))).alias("post"))
            if (i + 1) % cut_every == 0 or i + 1 == rounds:
                state = cut(state, "state")
    finally:
        e.unpersist()
    return state


def sybil_scar(edges: DataFrame, labels: DataFrame, rounds: int = 10, weight: float = 0.6, benign: float = 0.1, sybil: float = -0.1) -> DataFrame:
    """(id, posterior) by linearised loopy belief propagation; the sybil probability is 1 - posterior.

    ``edges`` (src, dst[, weight]) holds both directions; a weight column overrides ``weight`` per edge. Each
    round: post = clip(post + prior + 2 * sum((weight - 0.5) * neighbour), -0.5, 0.5).
    """
    w = (F.col("weight") if "weight" in edges.columns else F.lit(weight)) - 0.5
    e = edges.select("src", "dst", (2 * w).alias("weight"))
    v = priors(edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))), labels, benign, sybil, 0.0).withColumn("post", F.col("prior"))
    out = propagate(v, e, lambda post, prior, got: clip(post + prior + got, -0.5, 0.5), rounds)
    return out.select("id", (F.col("post") + 0.5).alias("posterior"))


def sybil_rank(edges: DataFrame, benign: DataFrame, alpha: float = 0.15, rounds: int | None = None) -> DataFrame:
    """(id, rank): an early-terminated random walk from benign seeds (one column, id), divided by degree.

    Without ``rounds`` the walk stops after floor(ln(number of nodes)) steps.
    """
    import math

    deg = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    if rounds is None:
        rounds = int(math.log(max(deg.count(), 1)))
    e = edges.join(deg, "src").select("src", "dst", sdiv(F.lit(1.0 - alpha), "degree").alias("weight"))
    seeds = benign.select("id").distinct().withColumn("p", F.lit(1.0))
    v = deg.select(F.col("src").alias("id")).join(seeds, "id", "left").select("id", F.coalesce("p", F.lit(0.0)).alias("prior")).withColumn("post", F.col("prior"))
    out = propagate(v, e, lambda _post, prior, got: got + alpha * prior, rounds)
    return out.join(deg.select(F.col("src").alias("id"), "degree"), "id").select("id", sdiv("post", "degree").alias("rank"))


def sybil_belief(edges: DataFrame, labels: DataFrame, rounds: int = 5, weight: float = 0.9, benign: float = 0.9, sybil: float = 0.1) -> DataFrame:
    """(id, posterior): loopy belief propagation on a pairwise Markov random field, synchronous schedule.

    Messages (src, dst, m) start at 0.5. The belief of a node is the normalised product of its incoming
    messages, kept as log sums; a message leaves out what its target sent, and is clipped to [1e-10, 1 - 1e-10].
    """
    eps = 1e-10
    v = cut(priors(edges.select(F.col("src").alias("id")), labels, benign, sybil, 0.5), "priors")
    m = edges.select("src", "dst").distinct().withColumn("m", F.lit(0.5))
    for i in range(rounds + 1):
        b = m.groupBy(F.col("dst").alias("id")).agg(F.sum(F.ln("m")).alias("lp"), F.sum(F.ln(1 - F.col("m"))).alias("ln"))
        b = v.join(b, "id", "left").na.fill(0.0, ["lp", "ln"])
        if i == rounds:
            odds = F.ln("prior") + F.col("lp") - F.ln(1 - F.col("prior")) - F.col("ln")
            return b.select("id", (1 / (1 + F.exp(-odds))).alias("posterior"))
        back = m.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("m").alias("r"))
        x = m.select("src", "dst").join(b.withColumnRenamed("id", "src"), "src").join(back, ["src", "dst"])
        odds = F.ln("prior") - F.ln(1 - F.col("prior")) + F.col("lp") - F.col("ln") - F.ln("r") + F.ln(1 - F.col("r"))
        q = 1 / (1 + F.exp(-odds))
        m = x.select("src", "dst", clip(weight * q + (1 - weight) * (1 - q), eps, 1 - eps).alias("m"))
        m = cut(m, "messages")
    raise AssertionError


def parameter_search(edges: DataFrame, labels: DataFrame, test: DataFrame, draws: int, seed: int = 42) -> list[dict]:
    """Random draws of (weight, benign, sybil, rounds) with the exact AUC of each on ``test`` (fid, bot), best first."""
    import random

    from rookery.ml.metrics import roc_auc

    rng = random.Random(seed)
    out = []
    for _ in range(draws):
        p = {"weight": rng.uniform(0.5, 1.0), "benign": rng.uniform(0.0, 0.5), "sybil": -rng.uniform(0.0, 0.5), "rounds": rng.randint(3, 10)}
        s = sybil_scar(edges, labels, **p).join(test.withColumnRenamed("fid", "id"), "id").select((1 - F.col("posterior")).alias("score"), F.col("bot").cast("int").alias("y"))
        out.append({**p, "auc": roc_auc(s, "score", "y").first()[0]})
    return sorted(out, key=lambda x: -(x["auc"] or 0))
