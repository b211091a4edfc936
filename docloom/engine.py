"""The engine: collections, requests, views, mutations, history and subscriptions over Spark tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import DELETED, Catalog, Collection, Index, Relation
from .functions import crdt
from .functions.predicate import compile_filter
from .operators import mutate
from .operators.lens import Transform
from .parser.query import Mutation, Operation, parse_request
from .parser.sdl import parse_schema
from .plans import explain
from .plans.planner import Frame, Planner
from .sources import backup, commits as log
from .sources.storage import cut
from .spec import Aggregate, Plain, Select
from .streaming.subscribe import subscribe
from .types import QueryError, spark_type


@dataclass
class View:
    select: Select
    transform: Transform | None
    path: str | None  # where it is kept, if it is materialized


#: So many mutations of a collection, or batches of commits, stay as they were appended; then they are put together.
PIECES = 16


class Engine:
    def __init__(self, spark: SparkSession, collections: list[Collection] | None = None) -> None:
        self.spark, self.catalog = spark, Catalog(collections)
        self.commits: DataFrame | None = None
        self._pieces: dict[str, int] = {}
        self._embedders: dict = {}
        self.views: dict[str, View] = {}
        self.planner = Planner(self.catalog, self._versions)

    # Collections

    def add_schema(self, text: str) -> list[str]:
        """Declares collections; they begin empty."""
        found = parse_schema(text)
        for c in found:
            df = self.spark.createDataFrame([], mutate.schema_of(c))
            self.catalog.add(replace(c, read=None if c.embedded else lambda df=df: df))
        return [c.name for c in found]

    def load(self, name: str, df: DataFrame) -> None:
        """Documents of a collection; fields that df lacks are null, its own types are cast to the declared ones."""
        c = self.catalog[name]
        if c.fields:
            kinds = {c.key: "string", **{n: spark_type(f.kind).simpleString() for n, f in c.fields.items() if f.kind}}
            df = df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()], (F.col(DELETED) if DELETED in df.columns else F.lit(False)).alias(DELETED))
        self.catalog.put(name, lambda: df)

    def create_index(self, name: str, index: Index) -> None:
        c = self.catalog[name]
        if index.unique:
            mutate.unique(c.documents(), [n for n, _ in index.fields])
        self.catalog.collections[name] = replace(c, indexes=(*c.indexes, index))

    def drop_index(self, name: str, index_name: str) -> None:
        c = self.catalog[name]
        self.catalog.collections[name] = replace(c, indexes=tuple(i for i in c.indexes if i.name != index_name))

    def indexes(self, name: str) -> tuple[Index, ...]:
        return self.catalog[name].indexes

    def write(self, name: str, path: str) -> None:
        """A collection as Parquet, laid out by its first index, so that scans skip row groups by their extremes; read from there afterwards."""
        c = self.catalog[name]
        df = c.documents()
        order = [F.col(n).desc() if down else F.col(n).asc() for n, down in c.indexes[0].fields] if c.indexes else [F.col(c.key)]
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
        self.catalog.put(name, lambda: self.spark.read.parquet(path))

    # Requests

    def select(self, select: Select) -> DataFrame:
        if select.name == "commits":
            return self._commits(select)
        if select.name == "latestCommits":
            return self._latest(select)
        if select.name in self.views:
            return self.planner.plan(select, self._view(select.name))
        if select.cid is not None:
            return self.planner.plan(select, self.at(select.name, select.cid))
        return self.planner.plan(select)

    def aggregate(self, aggregate: Aggregate) -> DataFrame:
        return self.planner.top(aggregate)

    def request(self, text: str, variables: dict | None = None, operation: str | None = None) -> dict[str, DataFrame] | dict[str, str]:
        """The roots of a request by name. With @explain their plans or figures instead."""
        op = parse_request(text, variables, operation)
        if op.kind == "subscription":
            raise QueryError("a subscription needs subscribe()")
        out = {x.select.out if isinstance(x, Mutation) else x.out: self._root(x) for x in op.roots}
        if op.explain:
            show = {"simple": explain.simple, "debug": explain.debug, "execute": explain.execute}[op.explain]
            return {k: show(v) for k, v in out.items()}
        return out

    def _root(self, x) -> DataFrame:
        if isinstance(x, Aggregate):
            return self.aggregate(x)
        return self.mutate(x) if isinstance(x, Mutation) else self.select(x)

    def subscribe(self, text: str, updates: DataFrame, sink, checkpoint: str, once: bool = False):
        """Runs the selection of a subscription for each batch of a stream of changed documents. Only filter is an argument."""
        op: Operation = parse_request(text)
        if op.kind != "subscription" or len(op.roots) != 1:
            raise QueryError("expected one subscription")
        s: Select = op.roots[0]
        if s != Select(s.name, s.items, filter=s.filter, alias=s.alias):
            raise QueryError("a subscription takes only filter")
        return subscribe(self.spark, updates, self.planner.plan, s, self.catalog[s.name].key, sink, checkpoint, once)

    # Mutations

    def _match(self, c: Collection, doc_ids, condition: dict | None) -> tuple[DataFrame, object]:
        """Documents with a column that says which of them match, and that column."""
        frame = Frame(self.planner, c, c.documents())
        test = compile_filter(condition, frame) & ~F.col(DELETED)
        if doc_ids is not None:
            test = test & F.col(c.key).isin([doc_ids] if isinstance(doc_ids, str) else list(doc_ids))
        df = frame.df.withColumn("__match", test).select(*c.documents().columns, "__match")
        return df, F.col("__match")

    def mutate(self, m: Mutation) -> DataFrame:
        """Carries out a mutation and gives the selection of the documents that it touched."""
        c, a = self.catalog[m.collection], m.arguments
        if m.action == "create":
            docs = a.get("input")
            docs = self._embedded(c, [docs] if isinstance(docs, dict) else list(docs or ()))
            new, ids, said = mutate.create(c, c.documents(), docs)
            new = cut(new)
            self._check(c, new, c.documents())
            values = log.deltas(new, c.key, {n: F.col(n) for n in c.fields}).join(said, ["docID", "fieldName"])
            self._commit(c, values, new, "active", first=True)
            self._append(c, c.documents().unionByName(new))
            return self.planner.plan(replace(m.select, doc_ids=tuple(ids)))
        if m.action == "upsert":
            if any(a.get(k) is None for k in ("filter", "create", "update")):
                raise QueryError("upsert needs filter, create and update")
            df, match = self._match(c, None, a["filter"])
            n = df.where(match).limit(2).count()
            if n > 1:
                raise QueryError("more than one document matches")
            if n == 0:
                return self.mutate(Mutation("create", m.collection, {"input": a["create"]}, m.select))
            return self.mutate(Mutation("update", m.collection, {"filter": a["filter"], "input": a["update"]}, m.select))
        df, match = self._match(c, a.get("docID"), a.get("filter"))
        touched = df.where(match).drop("__match")
        patch = a.get("input") or {}
        if m.action == "update":
            patch = self._embedded(c, [patch])[0]
            changed = cut(mutate.update(c, touched, F.lit(True), patch))
            self._check(c, changed, c.documents(), set(mutate.checked(c, patch, False)))
            values = mutate.patched(c, patch, changed)
            if values:
                self._commit(c, log.deltas(changed, c.key, values), changed, "active")
        else:
            changed = cut(mutate.delete(touched, F.lit(True)))
            none = self.spark.createDataFrame([], "docID string, fieldName string, delta string")
            self._commit(c, none, changed, "deleted")
        before = c.documents()
        self._append(c, before.join(changed.select(c.key), c.key, "left_anti").select(before.columns).unionByName(changed))
        # The result is of the documents that matched before the change.
        return self.planner.plan(replace(m.select, show_deleted=True), changed)

    def _append(self, c: Collection, df: DataFrame) -> None:
        """What a mutation adds is kept beside what was there; only every PIECES mutations the collection is written anew."""
        self._pieces[c.name] = self._pieces.get(c.name, 0) + 1
        if self._pieces[c.name] >= PIECES:
            self._pieces[c.name], df = 0, cut(df)
        self.catalog.put(c.name, lambda: df)

    def _commit(self, c: Collection, changes: DataFrame, docs: DataFrame, status: str, first: bool = False) -> None:
        ids = docs.select(F.col(c.key).cast("string").alias("docID"))
        new = cut(log.made(None if first else self.commits, changes.withColumn("docID", F.col("docID").cast("string")), ids, c.name, status, c.version))
        self._add_commits(new)

    def _add_commits(self, new: DataFrame) -> None:
        self.commits = new if self.commits is None else self.commits.unionByName(new, allowMissingColumns=True)
        self._pieces[""] = self._pieces.get("", 0) + 1
        if self._pieces[""] >= PIECES:
            self._pieces[""], self.commits = 0, cut(self.commits)

    def _check(self, c: Collection, changed: DataFrame, others: DataFrame, fields: set[str] | None = None) -> None:
        """Unique indexes, and that no two documents hold the same one in a one-to-one relation. fields: those that changed."""
        for index in c.indexes:
            names = [n for n, _ in index.fields]
            if index.unique and (fields is None or fields & set(names)):
                mutate.still_unique(c, changed, others, names, f"values of {', '.join(names)} must be unique")
        for r in c.relations.values():
            if r.own == c.key or r.many or r.target not in self.catalog or not (fields is None or r.own in fields):
                continue
            back = [x for x in self.catalog[r.target].relations.values() if x.target == c.name and x.other == r.own]
            if back and not back[0].many:
                mutate.still_unique(c, changed, others, [r.own], f"target document of {r.name} is already linked to another document")

    def embed_with(self, provider: str, function) -> None:
        """Documents that are created or updated get the embeddings that they lack and whose fields they set, from function(list of texts, model) -> list of lists."""
        self._embedders[provider] = function

    def _embedded(self, c: Collection, docs: list[dict]) -> list[dict]:
        """The documents of a request, with embeddings added; texts go to the function in one batch for each field."""
        docs = [dict(d) for d in docs]
        for name, f in c.fields.items():
            if not f.embedding or f.embedding.get("provider") not in self._embedders:
                continue
            sources = f.embedding.get("fields") or []
            todo = [d for d in docs if name not in d and any(d.get(s) is not None for s in sources)]
            if todo:
                texts = ["\n".join(str(d[s]) for s in sources if d.get(s) is not None) for d in todo]
                for d, v in zip(todo, self._embedders[f.embedding["provider"]](texts, f.embedding.get("model")), strict=True):
                    d[name] = list(v)
        return docs

    # Collections by name: what requests do, for callers that have documents at hand. All but delete return the selected fields, by default the key.

    def _run(self, action: str, name: str, arguments: dict, fields: tuple[str, ...]) -> DataFrame:
        items = tuple(Plain(f) for f in fields or (self.catalog[name].key,))
        return self.mutate(Mutation(action, name, arguments, Select(name, items)))

    def create(self, name: str, document: dict, *fields: str) -> DataFrame:
        return self._run("create", name, {"input": document}, fields)

    def create_many(self, name: str, documents: list[dict], *fields: str) -> DataFrame:
        return self._run("create", name, {"input": documents}, fields)

    def update(self, name: str, doc_id: str, patch: dict, *fields: str) -> DataFrame:
        if not self.exists(name, doc_id):
            raise QueryError(f"no document {doc_id}")
        return self._run("update", name, {"docID": doc_id, "input": patch}, fields)

    def save(self, name: str, document: dict, *fields: str) -> DataFrame:
        """Updates the document if its id exists, else creates it."""
        key = self.catalog[name].key
        rest = {k: v for k, v in document.items() if k != key}
        if document.get(key) is not None and self.exists(name, document[key]):
            return self.update(name, document[key], rest, *fields)
        return self.create(name, rest, *fields)

    def delete(self, name: str, doc_id: str) -> bool:
        if not self.exists(name, doc_id):
            raise QueryError(f"no document {doc_id}")
        self._run("delete", name, {"docID": doc_id}, ())
        return True

    def update_with_filter(self, name: str, condition: dict, patch: dict, *fields: str) -> DataFrame:
        return self._run("update", name, {"filter": condition, "input": patch}, fields)

    def delete_with_filter(self, name: str, condition: dict, *fields: str) -> DataFrame:
        return self._run("delete", name, {"filter": condition}, fields)

    def get(self, name: str, doc_id: str, show_deleted: bool = False) -> DataFrame:
        df = self.catalog[name].documents().where(F.col(self.catalog[name].key) == doc_id)
        return df if show_deleted else df.where(~F.col(DELETED))

    def exists(self, name: str, doc_id: str) -> bool:
        return not self.get(name, doc_id).isEmpty()

    def doc_ids(self, name: str) -> DataFrame:
        return self.catalog[name].documents().where(~F.col(DELETED)).select(F.col(self.catalog[name].key).alias("_docID"))

    def permitted(self, name: str, grants: DataFrame, identity: str) -> None:
        """From now on only documents of which grants (docID, identity) has a row are read."""
        c = self.catalog[name]
        mine = grants.where(F.col("identity") == identity).select(F.col("docID").alias(c.key)).distinct()
        self.catalog.put(name, lambda: c.documents().join(mine, c.key, "left_semi"))

    # Views

    def add_view(self, name: str, query: str | Select, transform: Transform | None = None, path: str | None = None, relations: dict[str, Relation] | None = None) -> None:
        """A collection that a query makes: read anew each time, or kept at path by refresh_view()."""
        select = parse_request(query).roots[0] if isinstance(query, str) else query
        self.views[name] = View(select, transform, path)
        self.catalog.add(Collection(name, key="__item", relations=relations or {}, read=lambda: self._view(name)))

    def _compute(self, name: str) -> DataFrame:
        v = self.views[name]
        df = self.select(v.select)
        return v.transform(df) if v.transform else df

    def _view(self, name: str) -> DataFrame:
        v = self.views[name]
        df = self._compute(name) if v.path is None else self.spark.read.parquet(v.path)
        if "__item" not in df.columns:
            df = df.withColumn("__item", F.monotonically_increasing_id())
        return df.withColumn(DELETED, F.lit(False))

    def refresh_view(self, name: str) -> None:
        v = self.views[name]
        if v.path is None:
            raise QueryError(f"{name} is not materialized")
        self._compute(name).withColumn("__item", F.monotonically_increasing_id()).write.mode("overwrite").parquet(v.path)

    # History

    def load_commits(self, df: DataFrame) -> None:
        self.commits = df

    def _log(self) -> DataFrame:
        return log.empty(self.spark) if self.commits is None else self.commits

    def _commits(self, s: Select) -> DataFrame:
        ids = s.doc_ids or (None,)
        df = log.query(self._log(), ids[0], s.arguments.get("fieldName"), s.cid, s.arguments.get("depth"))
        return self._of_log(df, s)

    def _latest(self, s: Select) -> DataFrame:
        if not s.doc_ids:
            raise QueryError("latestCommits needs a docID")
        df = log.latest(self._log().where(F.col("docID") == s.doc_ids[0]).where(F.col("fieldName") == s.arguments.get("fieldName", "_C")))
        return self._of_log(df, s)

    def _of_log(self, df: DataFrame, s: Select) -> DataFrame:
        c = Collection("commits", key="cid")
        frame = Frame(self.planner, c, df.withColumn(DELETED, F.lit(False)))
        items = tuple(Plain(x.name, x.alias) if isinstance(x, Select) and x.name in ("links", "heads", "signature") else x for x in s.items)
        s = replace(s, items=items, doc_ids=None, cid=None)
        rows, _ = self.planner.rows(frame, s, ())
        return self.planner.project(rows, s)

    def _versions(self, c: Collection, cid: str | None) -> DataFrame:
        df = self._log()
        if cid is not None:
            return log.ancestors(df, cid).where(F.col("fieldName") == "_C")
        return log.latest(df.where(F.col("fieldName") == "_C"))

    def at(self, name: str, cid: str) -> DataFrame:
        """Documents as they were at a commit: its ancestors, folded."""
        c = self.catalog[name]
        fields = {n: (f.merge, spark_type(f.kind).simpleString()) for n, f in c.fields.items()}
        return crdt.fold(log.ancestors(self._log(), cid), fields)

    def merge(self, name: str, more: DataFrame) -> None:
        """Adds commits from elsewhere and folds all of them into the collection. The order in which they come makes no difference."""
        c = self.catalog[name]
        known = more if self.commits is None else self.commits.unionByName(more, allowMissingColumns=True)
        self.commits = known.dropDuplicates(["cid"])
        fields = {n: (f.merge, spark_type(f.kind).simpleString()) for n, f in c.fields.items()}
        df = crdt.fold(self.commits.where(F.col("collection") == name), fields)
        self.catalog.put(name, lambda: df)

    # Backup

    def export(self, path: str, names: list[str] | None = None) -> None:
        """One text file with an object {collection: [documents]}, as restore() and other stores read it."""
        backup.write_backup(self._exported(names), path)

    def export_folder(self, path: str, names: list[str] | None = None) -> None:
        """A folder for each collection, written by many tasks at once."""
        backup.write_folder(self._exported(names), path)

    def _exported(self, names: list[str] | None) -> dict[str, DataFrame]:
        """Live documents, each with the id that it gets where it is restored, and relations rewritten to these."""
        names = names or [n for n, c in self.catalog.collections.items() if c.read and n not in self.views]
        cs = {n: self.catalog[n] for n in names}
        live = {n: c.documents().where(~F.col(DELETED)).drop(DELETED) for n, c in cs.items()}
        return backup.with_new_ids(live, cs)

    def restore(self, path: str, names: list[str], folder: bool = False) -> None:
        """Documents of the collections from export(), or from export_folder(), under their new ids."""
        schemas = {n: self.catalog[n].documents().drop(DELETED).schema for n in names}
        read = backup.read_folder if folder else backup.read_backup
        for n, df in read(self.spark, path, schemas, {n: self.catalog[n].key for n in names}).items():
            self.load(n, df)


def to_json(rows: dict[str, DataFrame]) -> str:
    """A request's results as one JSON text. They come to the driver, as an answer does."""
    return json.dumps({k: [json.loads(x) for x in df.toJSON().collect()] for k, df in rows.items()})
