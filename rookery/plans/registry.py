"""Registration of queries together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: registers a query under its function's name."""

        def put(f: Query) -> Query:
            if f.__name__ in self.queries:
                raise ValueError(f"two queries named {f.__name__}")
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return put


def rounded(**cols: str) -> str:
    """SQL select list of fractions rounded as the features are: halves away from 0, null becomes 0.

    The SQL engine rounds some exact halves down; a nudge far below the last digit makes it agree.
    """
    return ", ".join(f"coalesce(round(round(CAST(({e}) AS DOUBLE), 10) + sign(CAST(({e}) AS DOUBLE)) * 1e-12, 6), 0.0) AS {n}" for n, e in cols.items())


def whole(**cols: str) -> str:
    """SQL select list of whole numbers: null becomes 0."""
    return ", ".join(f"coalesce(CAST(({e}) AS BIGINT), 0) AS {n}" for n, e in cols.items())
