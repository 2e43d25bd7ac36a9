"""What changed between consecutive full snapshots of a table.

Every row is unpivoted into signed cells (pair of snapshots, key, field, value), minus for the earlier and
plus for the later snapshot of a pair, with one more cell that marks the key's presence. Cells that did not
change cancel; the sums that are left classify the key and name its changed fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_times(df: DataFrame, snapshot: str) -> list[int]:
    """The snapshots of a table in order: one number per full export, read from one column."""
    return sorted(r[0] for r in df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().collect())


def snapshot_changes(df: DataFrame, keys: Sequence[str], fields: Sequence[str], snapshot: str, times: Sequence[int] | None = None) -> DataFrame:
    """(keys, snapshot, change_kind, changed_fields), one row per key that differs between two consecutive snapshots.

    ``snapshot`` is the later one's time; change_kind is added, removed or changed; changed_fields are the
    names of the differing fields in order, null for added and removed. Null equals null and differs from
    the empty string. Rows repeated inside a snapshot count once. Should a snapshot hold several different
    rows of one key, the key is changed when the sets of its cells differ. Rows with a null in a key or in
    ``snapshot`` identify nothing and are left out. An empty table or a single snapshot has no changes.
    Columns other than those named, whatever they are called, are not read.

    One shuffle of whole rows by key; distinct, unpivoting and both sums stay in that partitioning.
    """
    times = list(times) if times is not None else snapshot_times(df, snapshot)
    ks = [f"k{i}" for i in range(len(keys))]
    rows = df.where(_no_nulls([*keys, snapshot])).select(
        *[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(snapshot).alias("at"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]
    )
    rows = rows.repartition(*ks).distinct()
    at = F.array(*[F.lit(t).cast("bigint") for t in times]).cast("array<bigint>")
    pos = F.array_position(at, F.col("at").cast("bigint")).cast("int")
    # pair p compares snapshots p and p + 1 (from 1); the row is the later of pair pos - 1 and the earlier of pair pos
    signed = F.filter(
        F.array(F.struct((pos - 1).alias("pair"), F.lit(1).alias("sign")), F.struct(pos.alias("pair"), F.lit(-1).alias("sign"))),
        lambda x: (x["pair"] >= 1) & (x["pair"] < len(times)),
    )
    cells = F.array(
        F.struct(F.lit(-1).alias("field"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(i).alias("field"), F.col(f"f{i}").cast("string").alias("value")) for i in range(len(fields))],
    )
    sums = (
        rows.select(*ks, F.explode(signed).alias("s"), cells.alias("cells"))
        .select(*ks, "s.pair", "s.sign", F.explode("cells").alias("c"))
        .groupBy(*ks, "pair", "c.field", "c.value")
        # a cell that several rows of one key share counts once per side
        .agg((F.max(F.when(F.col("sign") > 0, 1).otherwise(0)) - F.max(F.when(F.col("sign") < 0, 1).otherwise(0))).alias("d"))
        .where("d <> 0")
    )
    mark = F.max(F.when(F.col("field") == -1, F.col("d")))
    names = F.array(*[F.lit(f) for f in fields])
    changed = F.array_sort(F.collect_set(F.when(F.col("field") >= 0, F.col("field"))))
    kind = F.when(mark > 0, "added").when(mark < 0, "removed").otherwise("changed")
    return (
        sums.groupBy(*ks, "pair")
        .agg(kind.alias("change_kind"), F.when(mark.isNull(), F.transform(changed, lambda i: F.get(names, i))).alias("changed_fields"))
        .select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], F.get(at, F.col("pair")).alias(snapshot), "change_kind", "changed_fields")
    )


def _no_nulls(cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out
