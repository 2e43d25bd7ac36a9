"""Edge lists: mutual links, symmetric graphs, degrees, subgraphs, two-hop counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.features.common import finish
from rookery.functions.safe import sdiv


def mutual_pairs(links: DataFrame, src: str = "fid", dst: str = "target_fid") -> DataFrame:
    """(a, b), a < b, of accounts that link to each other; self-links and repeated links do not count.

    Distinct directed links, then one grouping of unordered pairs with exactly two directions: no self-join,
    and a busy account's pairs are spread by their other end.
    """
    a, b = F.least(src, dst), F.greatest(src, dst)
    d = links.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    both = d.groupBy(a.alias("a"), b.alias("b")).agg((F.max((F.col(src) < F.col(dst)).cast("int")) + F.max((F.col(src) > F.col(dst)).cast("int"))).alias("n"))
    return both.where("n = 2").select("a", "b")


def mutual_pairs_by_join(links: DataFrame, src: str = "fid", dst: str = "target_fid") -> DataFrame:
    """The same by a self-join on swapped keys, for comparison; prefer :func:`mutual_pairs`."""
    d = links.where(F.col(src) != F.col(dst)).select(F.col(src).alias("u"), F.col(dst).alias("v")).distinct()
    back = d.select(F.col("u").alias("v"), F.col("v").alias("u"))
    return d.where("u < v").join(back, ["u", "v"], "left_semi").select(F.col("u").alias("a"), F.col("v").alias("b"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """(src, dst) in both directions from unordered pairs (a, b)."""
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.explode(ends).alias("e")).select("e.src", "e.dst")


def node_ids(nodes: DataFrame, key: str, shards: int = 64) -> DataFrame:
    """(key, node_index): dense numbers from 0 in the order of the key, without a global sort in one task.

    Keys are ranked inside hash-free ranges: range partitioning, counts per partition, offsets. Rarely
    needed: joins work on the keys themselves.
    """
    from rookery.session import cut

    d = nodes.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(shards, key).withColumn("part__", F.spark_partition_id())
    d = cut(d, "nodes")
    sizes = d.groupBy("part__").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first__"))  # at most ``shards`` rows
    off = sizes.select("part__", (F.coalesce(F.sum("n").over(Window.orderBy("first__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("off__"))
    rank = F.row_number().over(Window.partitionBy("part__").orderBy(key)) - 1
    return d.withColumn("r__", rank).join(F.broadcast(off), "part__").select(key, (F.col("r__") + F.col("off__")).alias("node_index"))


def undirected(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, bot): the symmetric mutual graph with the label of the source, null where unlabelled."""
    return symmetric(mutual_pairs(links)).join(labels.select(F.col("fid").alias("src"), "bot"), "src", "left")


def induced(edges: DataFrame, nodes: DataFrame, src: str = "fid", dst: str = "target_fid") -> DataFrame:
    """Edges with both ends in ``nodes`` (one column, fid), self-links left out."""
    n = nodes.select(F.col("fid").alias("n__")).distinct()
    return edges.where(F.col(src) != F.col(dst)).join(n, F.col(src) == F.col("n__"), "left_semi").join(n, F.col(dst) == F.col("n__"), "left_semi")


def followees(edges: DataFrame, seeds: DataFrame, per_seed: int = 50) -> DataFrame:
    """Accounts that exactly one seed follows among its first ``per_seed`` targets by (timestamp, target)."""
    w = Window.partitionBy("fid").orderBy("timestamp", "target_fid")
    top = edges.join(seeds.select("fid").distinct(), "fid", "left_semi").select("fid", "target_fid", "timestamp").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_seed)
    one = top.groupBy("target_fid").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("target_fid").alias("fid"))
    return one.join(seeds.select("fid"), "fid", "left_anti")


def triangles(pairs: DataFrame) -> DataFrame:
    """(fid, degree, triangles, clustering) of an undirected graph given by unordered pairs (a, b).

    Edges point from the lower-degree to the higher-degree end, which bounds the two-hop join by the square
    root of the edges per node: hubs have few outgoing edges.
    """
    s = symmetric(pairs)
    deg = s.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    d = pairs.join(deg.select(F.col("src").alias("a"), F.col("degree").alias("da")), "a").join(deg.select(F.col("src").alias("b"), F.col("degree").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = d.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = o.select("u", F.col("v").alias("x")).join(o.select("u", F.col("v").alias("y")), "u").where("x < y")
    closed = wedge.join(o.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")), ["x", "y"], "left_semi")
    per = closed.select(F.explode(F.array("u", "x", "y")).alias("src")).groupBy("src").agg(F.count(F.lit(1)).alias("triangles"))
    x = deg.join(per, "src", "left").na.fill(0)
    return finish(x.select(F.col("src").alias("fid"), "degree", "triangles", sdiv(2 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)).alias("clustering")))
