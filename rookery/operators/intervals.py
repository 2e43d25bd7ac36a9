"""As-of matching against lifetimes, and the references that find none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators.skew import ROWS_PER_TASK, hot_groups, with_parts

#: Runs of integer keys are looked up by aligned ranges of so many keys.
KEY_RANGE = 256
#: Runs of at most so many ranges are broadcast (each range has at most KEY_RANGE / 2 runs of 16 bytes).
BROADCAST_RANGES = 50_000
_EVER = 9_223_372_036_854_775_807
_BEFORE = -9_223_372_036_854_775_808


def lifetime_runs(parents: DataFrame, key: str, start: str, end: str, chunk_us: int = 30 * 86_400_000_000) -> DataFrame:
    """(k, s, e, nr): the instants at which a key exists, compressed into runs numbered from 1.

    The instants of a key are integers (microseconds); each row of ``parents`` covers the contiguous range
    [start, end), without an end for a null ``end`` (e is then null). Ranges of one key that overlap or touch
    merge, so runs of a key are disjoint and sorted. Rows with a null key or start, and empty ranges, cover
    nothing. Inputs are expected as bigint columns.
    """
    far = F.lit(_EVER)
    rows = (
        parents.where(F.col(key).isNotNull() & F.col(start).isNotNull())
        .select(F.col(key).alias("k"), F.col(start).alias("s"), F.coalesce(F.col(end), far).alias("e"))
        .where("e > s")
        # one row per start: the widest; repeated rows vanish on the map side
        .groupBy("k", "s")
        .agg(F.max("e").alias("e"))
    )
    # ranges that start in one chunk of time merge first, so that a key with very many rows is divided
    by_chunk = _merged(rows.withColumn("c", F.expr(f"s div {chunk_us}")), ["k", "c"])
    runs = _merged(by_chunk.select("k", "s", "e"), ["k"])
    return runs.select("k", "s", F.when(F.col("e") < far, F.col("e")).alias("e"), F.col("run").cast("bigint").alias("nr"))


def _merged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint ranges (keys, s, e) from ranges that may overlap or touch."""
    order = Window.partitionBy(*keys).orderBy("s")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.coalesce(F.col("s") > F.max("e").over(before), F.lit(True)), 1).otherwise(0)
    x = ranges.withColumn("o", opens).withColumn("run", F.sum("o").over(upto))
    return x.groupBy(*keys, "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def key_runs(parents: DataFrame, key: str) -> DataFrame:
    """(at, runs): the integer keys of ``parents``, sorted and compressed into contiguous runs (a .. z).

    A run is cut at multiples of KEY_RANGE, so that ``runs``, the sorted runs of one aligned range of keys, has
    a bounded length, and the compression divides over the ranges: no task sorts all keys. Null keys and
    repeated rows add nothing.
    """
    ks = parents.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k")).distinct().withColumn("at", _range_of(F.col("k")))
    island = F.col("k") - F.row_number().over(Window.partitionBy("at").orderBy("k"))
    runs = ks.withColumn("island", island).groupBy("at", "island").agg(F.min("k").alias("a"), F.max("k").alias("z"))
    return runs.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("runs"))


def _range_of(k: Column) -> Column:
    return k - F.pmod(k, F.lit(KEY_RANGE))


def with_known(refs: DataFrame, runs: DataFrame, key: str, out: str = "known__") -> DataFrame:
    """``refs`` with ``out``: whether the key lies inside a run of :func:`key_runs`; null keys are in none.

    Every reference is matched as of its key to the preceding run start; it is beyond the run if the key is
    greater than the run's end. The join is by aligned ranges of keys.
    """
    r = runs.select(F.col("at").alias("at__"), F.col("runs").alias("runs__"))
    k = F.col(key)
    preceding = F.try_element_at(F.filter("runs__", lambda x: x["a"] <= k), F.lit(-1))
    j = refs.join(r, _range_of(k) == F.col("at__"), "left")
    return j.withColumn(out, F.coalesce(k <= preceding["z"], F.lit(False))).drop("at__", "runs__")


def orphans(refs: DataFrame, runs: DataFrame, key: str, at: str, rows_per_task: int = ROWS_PER_TASK, integer_keys: bool = False) -> DataFrame:
    """Rows of ``refs`` whose key does not exist at the row's instant, with ``orphan_kind``.

    Two as-of matches decide. Keys first, where they are integers (``integer_keys``): existing keys are
    compressed into contiguous runs, a reference is matched to the preceding run start, and one beyond the
    run's end is an orphan of kind ``never``, whatever its time. Then time: every other reference is matched as
    of its instant to the preceding start of its key's lifetimes and is an orphan when there is none or that
    lifetime has ended: ``gone`` (one ended before), ``later`` (the key comes only later) or ``never`` (no
    lifetime at all). References with a null key or instant refer to nothing and are not reported. Columns of
    ``refs`` are kept, whatever their names; one called orphan_kind is replaced. Empty inputs give no rows, or,
    without runs, every reference as ``never``. Equal rows are reported each.

    References and lifetimes merge in one sorted pass per (key, part). A key with more than ``rows_per_task``
    references is divided into parts by its count, each with a copy of that key's lifetimes.
    """
    kept = [c for c in refs.columns if c != "orphan_kind"]
    hashable = [F.col(f"row.`{c}`") for c in kept if "map" not in refs.schema[c].dataType.simpleString() and "variant" not in refs.schema[c].dataType.simpleString()]
    payload = F.struct(*[F.col(f"`{c}`") for c in kept])
    keyed = refs.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("t"), payload.alias("row"))
    hot = hot_groups(keyed.select("k"), ["k"], rows_per_task)
    part = F.when(F.col("parts__") > 1, F.pmod(F.xxhash64("t", *hashable), F.col("parts__"))).otherwise(0).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.col("parts__") - 1)).alias("part")
    left = with_parts(keyed, ["k"], hot).select("k", "t", part.alias("part"), "row")
    unknown: DataFrame | None = None
    if integer_keys:
        ranges = key_runs(runs, "k")
        if ranges.count() <= BROADCAST_RANGES:
            known = with_known(left, F.broadcast(ranges), "k")
        else:
            # too many to broadcast: each key is matched once, and its verdict meets the references part by part
            verdict = with_parts(with_known(keyed.select("k").distinct(), ranges, "k"), ["k"], hot).select("k", parts, "known__")
            known = left.join(verdict, ["k", "part"])
        unknown = known.where("NOT known__").select("row.*", F.lit("never").alias("orphan_kind"))
        left = known.where("known__").drop("known__")
    left = left.select("k", "t", "part", "row", F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("e"))
    # a key's first lifetime brings a mark that sorts before every instant: the key exists at some time
    marked = F.array_compact(F.array(F.when(F.col("nr") == 1, F.struct(F.lit(_BEFORE).alias("t"), F.lit(_BEFORE).alias("e"))), F.struct(F.col("s").alias("t"), F.coalesce("e", F.lit(_EVER)).alias("e"))))
    right = with_parts(runs, ["k"], hot).select("k", parts, marked.alias("m"))
    right = right.select("k", "part", F.explode("m").alias("m")).select("k", "m.t", "part", F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.lit(0).alias("side"), "m.e")
    order = Window.partitionBy("k", "part").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("until", F.last("e", True).over(order))
    kind = F.when(F.col("until").isNull(), "never").when(F.col("until") == _BEFORE, "later").otherwise("gone")
    out = both.where("side = 1 AND (until IS NULL OR until <= t)").select("row.*", kind.alias("orphan_kind"))
    return out if unknown is None else out.unionByName(unknown)
