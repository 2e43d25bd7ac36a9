"""Filling containers of fixed capacity with items, by optimal length buckets.

The sizes of all items form one global histogram of at most ``capacity`` bars. Dynamic programming over it
chooses the bucket boundaries that minimise padding, the room lost by counting each item as long as its
bucket's boundary. Buckets are then filled from the longest to the shortest: items of a bucket first top up
open containers that have just enough room left (best fit), and the rest form batches of as many items of
the bucket as the token budget holds. All of this runs on the histogram; an item learns its container from
its rank inside its bucket alone, so assignment is one narrow pass however many items a bucket has.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucket_boundaries(histogram: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets that minimise the padding of ``histogram``.

    ``histogram[s]`` is the number of items of size s. Dynamic programming in O(buckets * capacity * log capacity)
    time and O(buckets * capacity) memory. Only sizes that occur become boundaries; the largest always does.
    """
    sizes = np.flatnonzero(histogram)
    sizes = sizes[sizes > 0]
    if len(sizes) == 0:
        return []
    n = histogram[sizes].astype(float)
    m = len(sizes)
    count, total = np.concatenate([[0.0], np.cumsum(n)]), np.concatenate([[0.0], np.cumsum(n * sizes)])

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Padding when sizes i..j (inclusive) share the boundary sizes[j]."""
        return (count[j + 1] - count[i]) * sizes[j] - (total[j + 1] - total[i])

    at = np.arange(m)
    best, back = cost(np.zeros(m, np.int64), at), []
    for _ in range(min(buckets, m) - 1):
        cand, via = _layer(best, cost, m)
        better = cand < best
        back.append(np.where(better, via, -1).astype(np.int32))
        best = np.where(better, cand, best)
    out, j, layer = [], m - 1, len(back) - 1
    while True:
        out.append(int(sizes[j]))
        while layer >= 0 and back[layer][j] < 0:
            layer -= 1
        if layer < 0:
            break
        j = int(back[layer][j])
        layer -= 1
    return sorted(out)


def _layer(best: np.ndarray, cost: Callable[[np.ndarray, np.ndarray], np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
    """For every j the least best[i] + cost(i + 1, j) over i < j, and its i; infinite and -1 for j = 0.

    The best i never falls as j grows, so halving the range of j halves the ranges of i: all middles of one
    depth are settled side by side, in O(m log m) time and O(m) memory.
    """
    value, arg = np.full(m, np.inf), np.full(m, -1, np.int64)
    lo, hi = np.array([1]), np.array([m - 1])  # ranges of j, and of the i they may take
    first, last = np.array([0]), np.array([m - 2])
    while len(lo):
        ok = lo <= hi
        lo, hi, first, last = lo[ok], hi[ok], first[ok], last[ok]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        n = np.minimum(last, mid - 1) - first + 1
        start = np.cumsum(n) - n
        i = np.arange(n.sum()) - np.repeat(start - first, n)
        c = best[i] + cost(i + 1, np.repeat(mid, n))
        least = np.minimum.reduceat(c, start)
        hit = np.flatnonzero(c == np.repeat(least, n))
        pick = i[hit[np.searchsorted(hit, start)]]
        value[mid], arg[mid] = least, pick
        lo, hi, first, last = np.concatenate([lo, mid + 1]), np.concatenate([mid - 1, hi]), np.concatenate([first, pick]), np.concatenate([pick, last])
    return value, arg


@dataclass(frozen=True)
class Run:
    """Ranks [rank, rank + containers * per) of bucket ``bucket`` go, ``per`` at a time, to containers from ``first``."""

    bucket: int
    rank: int
    per: int
    containers: int
    first: int


def plan(counts: list[int], boundaries: list[int], capacity: int, first: int = 0) -> tuple[list[Run], int]:
    """(runs, next free container): where the ranks of every bucket go.

    Open containers are kept as runs of consecutive numbers per remaining room; a bucket takes from the
    tightest room that holds one more item. Each bucket adds at most one run per room, so the plan is bounded
    by the number of buckets times the capacity, not by the number of items.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs: list[Run] = []
    nxt = first

    def open_(r: int, start: int, k: int) -> None:
        if k > 0 and r > 0:
            if r not in room:
                room[r] = []
                bisect.insort(rooms, r)
            room[r].append((start, k))

    for b in range(len(boundaries) - 1, -1, -1):
        size, left, rank = boundaries[b], counts[b], 0
        opened: list[tuple[int, int, int]] = []
        i = bisect.bisect_left(rooms, size)
        while left and i < len(rooms):
            r = rooms[i]
            per = r // size
            while left and room[r]:
                start, k = room[r].pop()
                full = min(k, left // per)
                if full:
                    runs.append(Run(b, rank, per, full, start))
                    rank, left = rank + full * per, left - full * per
                    opened.append((r - per * size, start, full))
                if full < k and left < per and left:
                    runs.append(Run(b, rank, left, 1, start + full))
                    opened.append((r - left * size, start + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < k:
                    room[r].append((start + full, k - full))
                    break
            if not room[r]:
                del room[r]
                rooms.pop(i)
            else:
                i += 1
        if left:
            per = capacity // size
            full = left // per
            if full:
                runs.append(Run(b, rank, per, full, nxt))
                opened.append((capacity - per * size, nxt, full))
                rank, left, nxt = rank + full * per, left - full * per, nxt + full
            if left:
                runs.append(Run(b, rank, left, 1, nxt))
                opened.append((capacity - left * size, nxt, 1))
                nxt += 1
        for r, start, k in opened:
            open_(r, start, k)
    return runs, nxt


def pack(sizes: DataFrame, key: str, size: str, capacity: int, buckets: int = 256, shard_rows: int = 200_000) -> DataFrame:
    """(key, piece, piece_size, container), each item whole in one container unless it alone exceeds the capacity.

    ``sizes`` has a row per item and must be stable (a written table), as it is read several times: for the
    histogram, for the counts of the shards and for the assignment. Items larger than ``capacity`` are cut into
    full pieces, which fill a container each, and a rest that is packed like any item; ``piece`` counts from 0.
    Items of size 0 or null take no room and go to container 0. An empty table gives no rows. Repeated rows
    are items of their own. The same rows always get the same containers.

    The driver receives the histogram, at most ``capacity`` bars, and nothing else; the bucket of a size and the
    plan of a bucket are tables bounded by the capacity. A shard is a hash of the key and holds about
    ``shard_rows`` rows of a bucket at most; ranks are counted inside (bucket, shard), and where a shard's ranks
    begin is a running sum over its bucket's shards, kept in Spark.
    """
    spark = sizes.sparkSession
    s = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint"))
    items = sizes.select(F.col(key).alias("k"), s.alias("s"))
    rest = F.when(F.col("s") % capacity == 0, F.least(F.col("s"), F.lit(capacity))).otherwise(F.col("s") % capacity)
    items = items.select("k", "s", rest.cast("int").alias("r"), F.when(F.col("s") > 0, F.expr(f"(s - 1) div {capacity}")).otherwise(0).alias("full"))
    bars = items.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).toArrow()
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[bars["r"].to_numpy()] = bars["n"].to_numpy()
    n_rows, n_full = int(histogram.sum()), int(bars["full"].to_numpy().sum()) if len(bars) else 0
    bounds = bucket_boundaries(histogram, buckets)
    occurring = [x for x in np.flatnonzero(histogram).tolist() if x]
    of_size = np.searchsorted(bounds, occurring)
    counts = np.bincount(of_size, weights=histogram[occurring], minlength=len(bounds)).astype(np.int64).tolist() if occurring else []
    runs, after = plan(counts, bounds, capacity)
    size_table = spark.createDataFrame(list(zip(occurring, of_size.tolist())) or [(0, 0)], "r int, b int")
    by_bucket: dict[int, list[tuple[int, int, int]]] = {}
    for x in runs:
        by_bucket.setdefault(x.bucket, []).append((x.rank, x.per, x.first))
    plan_table = spark.createDataFrame([(b, sorted(v)) for b, v in by_bucket.items()] or [(0, [(0, 1, 0)])], "b int, runs array<struct<rank: bigint, per: bigint, first: bigint>>")

    shard = F.pmod(F.xxhash64("k"), F.lit(max(1, -(-n_rows // shard_rows)))).cast("int")
    tagged = items.where("s > 0").join(F.broadcast(size_table), "r").withColumn("h", shard)
    starts = _starts(tagged.groupBy("b", "h").agg(F.count(F.lit(1)).alias("n")), ["b"])
    # of its bucket's runs a shard keeps those that its own ranks fall into
    overlapping = F.filter("runs", lambda x, i: (x["rank"] < F.col("before") + F.col("n")) & (F.coalesce(F.get(F.col("runs"), i + 1)["rank"], F.lit(1 << 62)) > F.col("before")))
    starts = starts.join(F.broadcast(plan_table), "b").select("b", "h", "before", overlapping.alias("runs"))
    w = Window.partitionBy("b", "h").orderBy("k", "s")
    ranked = tagged.withColumn("i", F.row_number().over(w) - 1).join(starts, ["b", "h"])
    ranked = ranked.withColumn("i", F.col("i") + F.col("before")).withColumn("run", F.element_at(F.filter("runs", lambda x: x["rank"] <= F.col("i")), -1))
    out = ranked.select(
        F.col("k").alias(key), F.col("full").cast("int").alias("piece"), F.col("r").cast("bigint").alias("piece_size"), F.expr("run.first + (i - run.rank) div run.per").alias("container")
    )
    zero = F.lit(0).cast("bigint")
    out = out.unionAll(items.where("s = 0").select(F.col("k").alias(key), F.lit(0).alias("piece"), zero.alias("piece_size"), zero.alias("container")))
    if n_full:
        big = items.where("full > 0").withColumn("h", shard)
        begins = _starts(big.groupBy("h").agg(F.sum("full").alias("n")), [])
        upto = Window.partitionBy("h").orderBy("k", "s").rowsBetween(Window.unboundedPreceding, 0)
        big = big.withColumn("upto", F.sum("full").over(upto)).join(begins, "h")
        pieces = big.select("k", (F.col("before") + F.col("upto") - F.col("full") + after).alias("at"), F.explode(F.expr("sequence(0, CAST(full AS INT) - 1)")).alias("piece"))
        out = out.unionAll(pieces.select(F.col("k").alias(key), "piece", F.lit(capacity).cast("bigint").alias("piece_size"), (F.col("at") + F.col("piece")).alias("container")))
    return out


def _starts(per_shard: DataFrame, by: list[str]) -> DataFrame:
    """``per_shard`` (by, h, n) with before: the sum of n over the shards before h. One row per shard, so few rows meet."""
    before = Window.partitionBy(*by).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    return per_shard.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def split_items(assignment: DataFrame, key: str) -> DataFrame:
    """(key): items of the result of :func:`pack` whose pieces lie in more than one container.

    A key that occurs on several rows of the input is taken as one item.
    """
    a = assignment.groupBy(key).agg(F.min("container").alias("lo"), F.max("container").alias("hi"))
    return a.where("hi > lo").select(key)
