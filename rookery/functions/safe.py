"""Arithmetic and aggregates with one policy for nulls, zero divisors and NaN."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def sdiv(a: Column | str | float, b: Column | str | float, compat: bool = False) -> Column:
    """Float division; NULL on a zero divisor, or with ``compat`` inf, -inf or NaN as in IEEE arithmetic."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    if not compat:
        return a / F.nullif(b, F.lit(0.0))
    zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """Values outside [lo, hi] become the bound; null stays null."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def nunique(x: Column | str) -> Column:
    """Distinct values with NULL counted as a value of its own."""
    x = _c(x)
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0)).cast("bigint")


def count_if(p: Column) -> Column:
    """Rows for which ``p`` is true; 0 for no rows."""
    return F.count(F.when(p, F.lit(1)))


def nearest_quantile(x: Column | str, q: float) -> Column:
    """The order statistic at round((n-1)*q); exact, for groups of bounded size."""
    x = _c(x)
    at = F.round((F.count(x) - 1) * F.lit(float(q))).cast("int") + 1
    return F.try_element_at(F.array_sort(F.collect_list(x)), at)


def entropy2(n: Column | str, total: Column | str) -> Column:
    """Aggregate: Shannon entropy in bits of counts ``n`` that add up to ``total``."""
    p = sdiv(n, total)
    return -F.sum(p * F.log2(p))


def flag(p: Column) -> Column:
    """A predicate as 0 or 1; null stays null."""
    return p.cast("int")


def all_of(preds: Sequence[Column]) -> Column:
    """Conjunction of any number of predicates; true for none."""
    out = F.lit(True)
    for p in preds:
        out = out & p
    return out


def any_of(preds: Sequence[Column]) -> Column:
    """Disjunction of any number of predicates; false for none."""
    out = F.lit(False)
    for p in preds:
        out = out | p
    return out


def is_infinite(x: Column | str) -> Column:
    """True for inf and -inf; false for null and NaN."""
    return F.coalesce(F.abs(_c(x).cast("double")) == F.lit(float("inf")), F.lit(False))


def scalars(one_row: DataFrame) -> Callable[[str], Column]:
    """The columns of a one-row result as expressions for other queries: a scalar subquery, not a join."""
    row = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("r")).scalar()
    return lambda name: row.getField(name)
