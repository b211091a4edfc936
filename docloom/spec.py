"""Queries as values: what a selection asks for, before anything is planned."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Target:
    """What an aggregate runs over: a relation, an inline array, _group, or at the top a collection."""

    host: str
    field: str | None = None
    filter: dict | None = None
    order: list | None = None
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Plain:
    name: str
    alias: str = ""

    @property
    def out(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Aggregate:
    name: str  # _count, _sum, _avg, _min, _max
    targets: tuple[Target, ...]
    alias: str = ""

    @property
    def out(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Similarity:
    field: str
    vector: tuple[float, ...]
    alias: str = ""

    @property
    def out(self) -> str:
        return self.alias or "_similarity"


@dataclass(frozen=True)
class Select:
    """A selection from a collection, a relation, or the members of a group."""

    name: str
    items: tuple = ()
    filter: dict | None = None
    group_by: tuple[str, ...] | None = None
    order: tuple[dict, ...] = ()
    limit: int | None = None
    offset: int | None = None
    doc_ids: tuple | None = None
    show_deleted: bool = False
    cid: str | None = None
    alias: str = ""
    arguments: dict = field(default_factory=dict)  # what special roots take besides, such as depth

    @property
    def out(self) -> str:
        return self.alias or self.name


def count(*hosts: str | Target, alias: str = "") -> Aggregate:
    return _aggregate("_count", hosts, alias)


def total(*targets: str | Target, alias: str = "") -> Aggregate:
    return _aggregate("_sum", targets, alias)


def average(*targets: str | Target, alias: str = "") -> Aggregate:
    return _aggregate("_avg", targets, alias)


def least(*targets: str | Target, alias: str = "") -> Aggregate:
    return _aggregate("_min", targets, alias)


def greatest(*targets: str | Target, alias: str = "") -> Aggregate:
    return _aggregate("_max", targets, alias)


def _aggregate(name: str, targets, alias: str) -> Aggregate:
    return Aggregate(name, tuple(Target(t) if isinstance(t, str) else t for t in targets), alias)
