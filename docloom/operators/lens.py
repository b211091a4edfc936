"""Transforms of documents: on views, and between versions of a schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


def set_default(name: str, value) -> Transform:
    """Sets a field, adding it where it is missing."""
    return lambda df: df.withColumn(name, F.lit(value))


def remove(name: str) -> Transform:
    return lambda df: df.drop(name)


def copy(source: str, target: str) -> Transform:
    return lambda df: df.withColumn(target, F.col(source))


def keep(name: str, value) -> Transform:
    """Only documents with this value."""
    return lambda df: df.where(F.col(name).eqNullSafe(F.lit(value)))


def prepend(values: dict) -> Transform:
    """One more document, with these values and nulls otherwise."""

    def apply(df: DataFrame) -> DataFrame:
        one = df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
        return one.unionByName(df)

    return apply


def mapped(function: Callable, schema: str) -> Transform:
    """Any function from batches of documents to batches, for what columns can't express."""
    return lambda df: df.mapInArrow(function, schema)


def chain(*steps: Transform) -> Transform:
    return lambda df: reduce(lambda x, f: f(x), steps, df)


@dataclass
class History:
    """Versions of a schema and the migrations between neighbours; documents of any version are read as any other."""

    steps: dict[tuple[str, str], Transform] = field(default_factory=dict)

    def migrate(self, old: str, new: str, up: Transform, down: Transform | None = None) -> None:
        self.steps[old, new] = up
        if down is not None:
            self.steps[new, old] = down

    def path(self, old: str, new: str) -> list[Transform]:
        todo, seen = [(old, [])], {old}
        while todo:
            at, way = todo.pop(0)
            if at == new:
                return way
            for (a, b), step in self.steps.items():
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append((b, [*way, step]))
        raise ValueError(f"no migrations lead from {old} to {new}")

    def read(self, versions: dict[str, DataFrame], wanted: str) -> DataFrame:
        """Documents of all versions as of the wanted one. Where a field is missing it is null."""
        parts = [chain(*self.path(v, wanted))(df) for v, df in versions.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def write_back(self, versions: dict[str, DataFrame], wanted: str, path: str) -> dict[str, DataFrame]:
        """Stores documents of all versions as of the wanted one at path, so that they are migrated once; what versions are from then on."""
        df = self.read(versions, wanted)
        df.write.parquet(path)
        return {wanted: df.sparkSession.read.schema(df.schema).parquet(path)}
