"""Collections, their fields and relations, and where their documents come from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .types import COUNTERS, QueryError, SchemaError

DELETED = "_deleted"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = ""  # of the schema language; "" where the table's own type holds
    merge: str = "lww"
    default: object = None
    size: int | None = None
    embedding: dict | None = None

    def __post_init__(self) -> None:
        if self.merge not in ("lww", "pncounter", "pcounter"):
            raise SchemaError(f"unknown merge type {self.merge}")
        if self.merge != "lww" and self.kind and self.kind not in COUNTERS:
            raise SchemaError(f"{self.name}: a counter must be a number")


@dataclass(frozen=True)
class Relation:
    """own = other joins a document to those of target; many tells whether there may be several of them."""

    name: str
    target: str
    many: bool
    own: str
    other: str


@dataclass(frozen=True)
class Index:
    """A declared order of documents: it fixes layout when a collection is written, and uniqueness is checked then."""

    fields: tuple[tuple[str, bool], ...]  # name, descending
    name: str = ""
    unique: bool = False


@dataclass(frozen=True)
class Collection:
    name: str
    key: str = "_docID"
    fields: dict[str, Field] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    indexes: tuple[Index, ...] = ()
    json: frozenset[str] = frozenset()  # fields that hold JSON text
    read: Callable[[], DataFrame] | None = None
    #: Policy id and resource, branchable, materialized: kept as declared.
    options: dict = field(default_factory=dict)
    embedded: bool = False

    def documents(self) -> DataFrame:
        """The documents with their deletion mark, false where the source has none."""
        if self.read is None:
            raise QueryError(f"{self.name} has no documents")
        df = self.read()
        return df if DELETED in df.columns else df.withColumn(DELETED, F.lit(False))

    def relation(self, name: str) -> Relation | None:
        return self.relations.get(name)

    @property
    def version(self) -> str:
        """The same for the same declared fields."""
        said = json.dumps([self.name, [(n, f.kind, f.merge) for n, f in sorted(self.fields.items())]])
        return "v" + hashlib.sha256(said.encode()).hexdigest()


class Catalog:
    def __init__(self, collections: list[Collection] | None = None) -> None:
        self.collections: dict[str, Collection] = {}
        for c in collections or ():
            self.add(c)

    def add(self, collection: Collection) -> None:
        if collection.name in self.collections:
            raise SchemaError(f"collection {collection.name} exists")
        self.collections[collection.name] = collection

    def put(self, name: str, read: Callable[[], DataFrame]) -> None:
        """Sets where a collection's documents come from."""
        self.collections[name] = replace(self[name], read=read)

    def __getitem__(self, name: str) -> Collection:
        if name not in self.collections:
            raise QueryError(f"no collection {name}")
        return self.collections[name]

    def __contains__(self, name: str) -> bool:
        return name in self.collections
