"""Per-key results over inputs in which a few keys hold most rows.

Eager aggregation: every input is reduced to one compact state per key before anything is joined. The
reduction combines on the map side, so a key with a third of all rows costs each map task one state row;
the join then meets every key once per input, whatever its share. Results of the join that was avoided
follow from algebra on the states: its rows per key are the product of the counts, a sum over it is the
sum of one side times the count of the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class KeyedInput:
    """One input: ``name`` prefixes its columns, ``key`` is the join key, ``sums`` are columns to add up."""

    df: DataFrame
    name: str
    key: str
    sums: Sequence[str] = field(default=())


def key_states(x: KeyedInput) -> DataFrame:
    """(key, <name>_rows, <name>_<column>_sum ...) of one input; rows with a null key form one state.

    Sums of whole numbers are decimal(38, 0), as those of busy keys outgrow bigint.
    """
    whole = lambda c: F.sum(x.df[c].cast("decimal(20,0)")).cast("decimal(38,0)") if isinstance(x.df.schema[c].dataType, T.IntegralType) else F.sum(x.df[c])
    return x.df.groupBy(F.col(x.key).alias("key")).agg(
        F.count(F.lit(1)).alias(f"{x.name}_rows"),
        *[whole(c).alias(f"{x.name}_{c}_sum") for c in x.sums],
    )


def eager_states(inputs: Sequence[KeyedInput]) -> DataFrame:
    """Full outer join of the states: one row per key of any input, counts 0 where it is missing.

    The null keys of different inputs do not match each other and stay one row per input. An empty input
    adds no keys. Inputs may share column names.
    """
    out: DataFrame | None = None
    for x in inputs:
        s = key_states(x)
        out = s if out is None else out.join(s, "key", "full")
    assert out is not None, "at least one input"
    return out.na.fill(0, [f"{x.name}_rows" for x in inputs])


def join_totals(states: DataFrame, left: str, right: str, left_sums: Sequence[str] = (), right_sums: Sequence[str] = ()) -> DataFrame:
    """Per key, what grouping the inner join of two inputs would give, without running that join.

    ``pairs`` is the row count of the join; ``<input>_<column>_joined`` the sum of the column over it.
    Counts are multiplied as decimals, so products of whole numbers are decimal(38, 0): they outgrow bigint for
    busy keys.
    """
    n = lambda x: F.col(f"{x}_rows").cast("decimal(19,0)")
    times = lambda total, x: (F.col(total) * (n(x) if isinstance(states.schema[total].dataType, T.DecimalType) else F.col(f"{x}_rows"))).alias(total.removesuffix("_sum") + "_joined")
    inner = states.where(F.col("key").isNotNull() & (F.col(f"{left}_rows") > 0) & (F.col(f"{right}_rows") > 0))
    return inner.select(
        "key",
        (n(left) * n(right)).alias("pairs"),
        *[times(f"{left}_{c}_sum", right) for c in left_sums],
        *[times(f"{right}_{c}_sum", left) for c in right_sums],
    )


def heavy_keys(inputs: Sequence[KeyedInput], percent: int) -> DataFrame:
    """(key_field, key, n, total): keys that hold at least ``percent`` of all rows of an input; its name is the key_field.

    The states of all inputs are joined with the totals their own roll-up gives, and the counts multiplied out:
    no row of an input meets another. Rows with a null key count in the total but are no key. At most
    100 / percent keys per input come out, whatever the size of the data; the totals that are broadcast are
    one row per input.
    """
    cells: DataFrame | None = None
    for x in inputs:
        s = key_states(KeyedInput(x.df, "x", x.key)).select("key", F.lit(x.name).alias("key_field"), F.col("x_rows").alias("n"))
        cells = s if cells is None else cells.unionAll(s)
    assert cells is not None, "at least one input"
    totals = cells.groupBy("key_field").agg(F.sum("n").alias("total"))
    share = F.col("n").cast("decimal(19,0)") * 100 >= F.col("total").cast("decimal(19,0)") * percent
    return cells.where("key IS NOT NULL").join(F.broadcast(totals), "key_field").where(share).select("key_field", "key", "n", "total")
