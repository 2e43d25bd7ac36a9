"""Feature sets declared as data, their order by dependency, and the matrix built from them with a cache."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.features.common import left_joined
from rookery.session import cut, tidy


@dataclass(frozen=True)
class FeatureSet:
    """``build(context)`` gives one row per account with ``outputs``; ``needs`` are sets it reads; ``version`` names its definition."""

    name: str
    outputs: Sequence[str]
    build: Callable[[FeatureContext], DataFrame]
    needs: Sequence[str] = ()
    version: str = "1"


@dataclass
class FeatureContext:
    """What a feature set may read: the session, the folder, and the sets built before it.

    ``delivery`` names the state of the data in the folder; where it is rewritten in place, give its end time.
    """

    spark: SparkSession
    folder: str
    built: dict[str, DataFrame] = field(default_factory=dict)
    delivery: str = ""


class FeatureRegistry:
    """Named feature sets; every output column has one owner."""

    def __init__(self) -> None:
        self.sets: dict[str, FeatureSet] = {}

    def register(self, s: FeatureSet) -> None:
        """Add a set; a column that another set owns, or a second set of the name, is an error."""
        if s.name in self.sets:
            raise ValueError(f"{s.name} is registered already")
        owned = {c: o.name for o in self.sets.values() for c in o.outputs}
        clash = [c for c in s.outputs if c in owned]
        if clash:
            raise ValueError(f"{', '.join(clash)} of {s.name} belong to {owned[clash[0]]}")
        self.sets[s.name] = s

    def provider(self, feature: str) -> str | None:
        """The set that owns a feature."""
        return next((s.name for s in self.sets.values() if feature in s.outputs), None)

    def available(self) -> list[str]:
        return [c for n in sorted(self.sets) for c in self.sets[n].outputs]

    def order(self, wanted: Iterable[str] | None = None) -> list[str]:
        """Sets in an order in which each follows what it needs; unknown names and cycles are errors."""
        out: list[str] = []
        state: dict[str, int] = {}

        def visit(n: str) -> None:
            if n not in self.sets:
                raise KeyError(f"no feature set {n}")
            if state.get(n) == 1:
                raise ValueError(f"{n} needs itself")
            if n not in state:
                state[n] = 1
                for m in self.sets[n].needs:
                    visit(m)
                state[n] = 2
                out.append(n)

        for n in sorted(self.sets) if wanted is None else wanted:
            visit(n)
        return out


class FeatureManager:
    """Builds the matrix: all sets in one plan over all accounts, or, with a cache folder, only what is not stored.

    With ``batch``, sets are written one by one and joined by so many at a time, so that no task holds the sorts and
    the code of more joins than that; for many sets one plan outgrows an executor.
    """

    def __init__(self, registry: FeatureRegistry, context: FeatureContext, cache: str | None = None, key: str = "fid", batch: int | None = None):
        self.registry, self.context, self.cache, self.key, self.batch = registry, context, cache, key, batch

    def _built(self, n: str) -> DataFrame:
        s, c = self.registry.sets[n], self.context
        if n not in c.built:
            if self.cache is None:
                c.built[n] = s.build(c)
            else:
                state = hashlib.sha256(f"{c.folder}\n{c.delivery}".encode()).hexdigest()[:16]
                path = f"{self.cache}/{n}-v{s.version}-{state}.parquet"
                if not self._exists(path):
                    s.build(c).select(self.key, *s.outputs).write.parquet(path)
                c.built[n] = c.spark.read.parquet(path)
        return c.built[n].select(self.key, *s.outputs)

    def _exists(self, path: str) -> bool:
        p = self.context.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.context.spark._jsc.hadoopConfiguration()).exists(p)

    def matrix(self, spine: DataFrame, sets: Iterable[str] | None = None) -> DataFrame:
        """One row per key of ``spine`` with the features of ``sets`` (None: all); missing ones are 0, NaN stays."""
        names = self.registry.order(sets)
        keys = spine.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("bigint").alias(self.key)).distinct()
        if self.batch is None:
            groups = [self._built(n) for n in names]
        else:
            keys, groups = cut(keys, "spine"), []
            for n in names:
                groups.append(cut(self._built(n), n))
                tidy(self.context.spark)
            while len(groups) > max(2, self.batch):
                groups = [cut(left_joined(keys, groups[i : i + max(2, self.batch)], self.key), "batch") for i in range(0, len(groups), max(2, self.batch))]
        out = left_joined(keys, groups, self.key)
        return out.select(self.key, *[F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)).alias(c) for c in out.columns if c != self.key])

    def features_for(self, fids: Sequence[int], sets: Iterable[str] | None = None) -> DataFrame:
        """The matrix rows of some accounts; the filter reaches every set through the joins on the key."""
        spine = self.context.spark.createDataFrame([(int(f),) for f in fids], f"`{self.key}` bigint")
        return self.matrix(spine, sets)
