"""From a selection to a DataFrame.

The steps of a selection are always in the same order: scan, filter, relations and aggregates, groups, filters on
aliases, order, limit, projection. Each is an ordinary DataFrame operation, so predicates reach the scan and Catalyst
picks the joins. Aggregates over relations without order or limit are grouped on the child's side before the join;
only nested selections gather lists, as their result is one."""

from __future__ import annotations

import itertools
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..catalog import DELETED, Catalog, Collection, Relation
from ..functions import arrays
from ..functions.predicate import compile_filter
from ..spec import Aggregate, Plain, Select, Similarity, Target
from ..types import NUMERIC, WHOLE, QueryError

_fresh = itertools.count()


def fresh(what: str) -> str:
    return f"__{what}{next(_fresh)}"


class Missing:
    """The scope of a related document that isn't there: every field is null."""

    def __init__(self, planner: Planner, collection: Collection) -> None:
        self.planner, self.collection = planner, collection
        self.schema = {f.name: f.dataType for f in collection.documents().schema}

    def field(self, name: str):
        return (F.lit(None).cast(self.schema[name]), self.schema[name]) if name in self.schema else None

    def is_json(self, name: str) -> bool:
        return name in self.collection.json

    def related(self, name: str, condition: dict) -> Column | None:
        if (r := self.collection.relation(name)) is None:
            return None
        return F.lit(False) if r.many else compile_filter(condition, Missing(self.planner, self.planner.catalog[r.target]))

    def aliased(self, name: str):
        raise QueryError(f"no alias {name} in a related document")


class Frame:
    """Documents on their way through a selection: the DataFrame so far, and what names mean in it."""

    def __init__(self, planner: Planner, collection: Collection, df: DataFrame) -> None:
        self.planner, self.collection, self.df = planner, collection, df
        self.base = set(df.columns)
        self.aliases: dict[str, str] = {}
        #: Fields of each target that a selection aggregates, and the columns of those that are joined on.
        self.wanted: dict[str, list[str | None]] = {}
        self.pooled: dict[tuple[str, str | None], str] = {}

    def kind(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType

    def field(self, name: str):
        if name == "_docID":
            name = self.collection.key
        if name in self.base:
            return F.col(f"`{name}`"), self.kind(name)
        if name.endswith("_id") and (r := self.collection.relation(name[:-3])) and not r.many:
            if r.own != self.collection.key:
                return F.col(f"`{r.own}`"), self.kind(r.own)
            # The other side holds the reference: its document's id is read by a join.
            child = self.planner.catalog[r.target]
            got = self.attach(child.documents().where(~F.col(DELETED)), r, [F.col(child.key)])
            return F.col(got[0]), self.kind(got[0])
        return None

    def is_json(self, name: str) -> bool:
        return name in self.collection.json

    def attach(self, child: DataFrame, r: Relation, columns: list[Column]) -> list[str]:
        """Left joins columns of the child by the relation, under new names."""
        key, names = fresh("k"), [fresh("c") for _ in columns]
        right = child.where(F.col(f"`{r.other}`").isNotNull()).select(F.col(f"`{r.other}`").alias(key), *[c.alias(n) for c, n in zip(columns, names)])
        self.df = self.df.join(right, F.col(f"`{r.own}`") == F.col(key), "left").drop(key)
        return names

    def related(self, name: str, condition: dict) -> Column | None:
        if (r := self.collection.relation(name)) is None:
            return None
        child = self.planner.frame(r.target)
        if condition is None or condition == {"_eq": None} or condition == {"_ne": None}:
            flag = self.attach(child.df.select(r.other).distinct(), r, [F.lit(True)])[0]
            return F.col(flag).isNotNull() if condition == {"_ne": None} else F.col(flag).isNull()
        hit = compile_filter(condition, child, loose=r.many)
        if r.many:
            flag = self.attach(child.df.where(hit).select(r.other).distinct(), r, [F.lit(True)])[0]
            return F.coalesce(F.col(flag), F.lit(False))
        flag = self.attach(child.df, r, [hit])[0]
        return F.coalesce(F.col(flag), compile_filter(condition, Missing(self.planner, child.collection)))

    def aliased(self, name: str):
        if name in self.aliases:
            return F.col(self.aliases[name]), self.kind(self.aliases[name])
        if (found := self.field(name)) is not None:
            return found
        raise QueryError(f"no alias {name}")

    def put(self, alias: str, value: Column) -> None:
        name = fresh("v")
        self.df = self.df.withColumn(name, value)
        self.aliases[alias] = name


def _has_alias(x) -> bool:
    return isinstance(x, dict) and ("_alias" in x or any(map(_has_alias, x.values()))) or isinstance(x, (list, tuple)) and any(map(_has_alias, x))


def _split(condition: dict | None) -> tuple[dict, dict]:
    """What can be tested before aliases are known, and what not."""
    before, after = {}, {}
    for k, v in (condition or {}).items():
        if k == "_and" and _has_alias(v):
            before["_and"], after["_and"] = [x for x in v if not _has_alias(x)], [x for x in v if _has_alias(x)]
        else:
            (after if k == "_alias" or _has_alias(v) else before)[k] = v
    return before, after


class Planner:
    def __init__(self, catalog: Catalog, versions=None) -> None:
        """versions: (collection, cid or None) -> its commits, newest first, as a DataFrame with docID."""
        self.catalog, self.versions = catalog, versions

    def frame(self, name: str, show_deleted: bool = False, df: DataFrame | None = None) -> Frame:
        c = self.catalog[name]
        df = c.documents() if df is None else df
        return Frame(self, c, df if show_deleted else df.where(~F.col(DELETED)))

    # Roots

    def plan(self, select: Select, df: DataFrame | None = None) -> DataFrame:
        """The result of a selection from a collection. df: its documents, if not those of the catalog."""
        frame = self.frame(select.name, select.show_deleted, df)
        rows, order = self.rows(frame, select, ())
        return self.project(rows, select)

    def top(self, aggregate: Aggregate) -> DataFrame:
        """An aggregate over whole collections: one row."""
        parts = []
        for t in aggregate.targets:
            frame = self.frame(t.host)
            value = self._members(frame, t, ())[0]
            parts.append(frame.df.agg(*_partials(value)))
        whole = all(isinstance(p.schema["s"].dataType, WHOLE) for p in parts)
        if not whole:
            parts = [p.select("n", "m", *[F.col(c).cast("double").alias(c) for c in ("s", "lo", "hi")]) for p in parts]
        every = reduce(DataFrame.union, parts).agg(*[F.struct(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).alias("p")])
        return every.select(_combined(aggregate.name, [F.col("p")], whole).alias(aggregate.out))

    # Selections

    def rows(self, frame: Frame, select: Select, within: tuple[str, ...]) -> tuple[Frame, list[Column]]:
        """The frame after filter, aggregates, groups, order and limit; within: columns whose values each have their own order and limit."""
        if select.doc_ids is not None:
            frame.df = frame.df.where(F.col(frame.collection.key).isin(list(dict.fromkeys(select.doc_ids))))
        before, after = _split(select.filter)
        before = self.semi(frame, before)
        if before:
            test = compile_filter(before, frame, loose=True)
            frame.df = frame.df.where(test)
        if select.group_by is not None:
            frame = self.group(frame, select, within)
        else:
            if any(isinstance(x, (Select, Aggregate)) and ("_group" in (x.name, *[t.host for t in getattr(x, "targets", ())])) for x in select.items):
                raise QueryError("_group needs groupBy")
            for item in select.items:
                for t in item.targets if isinstance(item, Aggregate) else ():
                    if t.field not in frame.wanted.setdefault(_target(t), []):
                        frame.wanted[_target(t)].append(t.field)
            for item in select.items:
                self.item(frame, item, select)
        if after:
            test = compile_filter(after, frame, loose=True)
            frame.df = frame.df.where(test)
        order = self.order(frame, select.order)
        tie = [F.col(f"`{frame.collection.key}`")] if select.group_by is None else [F.asc_nulls_first(f"`{self.key_column(frame, g)}`") for g in select.group_by]
        if select.limit or select.offset:
            if within:
                rank = fresh("r")
                w = Window.partitionBy(*within).orderBy(*order, *tie)
                first = select.offset or 0
                frame.df = frame.df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) > first)
                if select.limit:
                    frame.df = frame.df.where(F.col(rank) <= first + select.limit)
            else:
                frame.df = frame.df.orderBy(*order, *tie)
                frame.df = frame.df.offset(select.offset) if select.offset else frame.df
                frame.df = frame.df.limit(select.limit) if select.limit else frame.df
        elif order and not within:
            frame.df = frame.df.orderBy(*order, *tie)
        return frame, [*order, *tie]

    def semi(self, frame: Frame, condition: dict) -> dict:
        """Conditions on several related documents that stand alone, plain or negated, are semi and anti joins; gives what is left."""
        left = {}
        for key, value in condition.items():
            inner = value if key == "_not" and isinstance(value, dict) and len(value) == 1 else {key: value}
            (name, test), = inner.items()
            r = frame.collection.relation(name)
            if r is None or not r.many or not isinstance(test, dict) or not test or set(test) & {"_eq", "_ne"}:
                left[key] = value
                continue
            child = self.frame(r.target)
            other = fresh("k")
            hit = compile_filter(test, child, loose=True)  # may join to child.df
            keys = child.df.where(hit).select(F.col(f"`{r.other}`").alias(other))
            frame.df = frame.df.join(keys, F.col(f"`{r.own}`") == F.col(other), "left_anti" if key == "_not" else "left_semi")
        return left

    def item(self, frame: Frame, item, select: Select) -> None:
        if isinstance(item, Plain):
            if item.name == "__typename":
                frame.put(item.out, F.lit(frame.collection.name))
            elif (found := frame.field(item.name)) is not None:
                frame.put(item.out, found[0])
            else:
                raise QueryError(f"{frame.collection.name} has no field {item.name}")
        elif isinstance(item, Similarity):
            if (found := frame.field(item.field)) is None:
                raise QueryError(f"{frame.collection.name} has no field {item.field}")
            frame.put(item.out, arrays.similarity(*found, list(item.vector)))
        elif isinstance(item, Aggregate):
            frame.put(item.out, self.aggregate(frame, item))
        elif item.name == "_version":
            self.version(frame, item, select.cid)
        else:
            self.nest(frame, item)

    def order(self, frame: Frame, spec: tuple[dict, ...]) -> list[Column]:
        out = []
        for entry in spec:
            if len(entry) != 1:
                raise QueryError("one field for each order entry")
            (name, way), at = next(iter(entry.items())), frame
            if name == "_alias":
                (name, way), found = next(iter(way.items())), None
                found = frame.aliased(name)[0]
            elif isinstance(way, dict):
                found, r = None, frame.collection.relation(name)
                if r is None or r.many:
                    raise QueryError(f"can't order by {name}")
                child = self.frame(r.target)
                path = way
                inner = Select(r.target, order=(path,))
                key = self.order_column(child, inner.order[0])
                found = F.col(at.attach(child.df, r, [key])[0])
                while isinstance(path, dict):
                    path = next(iter(path.values()))
                way = path
            else:
                got = frame.field(name)
                if got is None:
                    got = frame.aliased(name)
                found = got[0]
            out.append(found.desc_nulls_last() if str(way).upper() == "DESC" else found.asc_nulls_first())
        return out

    def order_column(self, frame: Frame, entry: dict) -> Column:
        name, way = next(iter(entry.items()))
        if isinstance(way, dict):
            r = frame.collection.relation(name)
            if r is None or r.many:
                raise QueryError(f"can't order by {name}")
            child = self.frame(r.target)
            key = self.order_column(child, way)
            return F.col(frame.attach(child.df, r, [key])[0])
        if (got := frame.field(name)) is None:
            raise QueryError(f"can't order by {name}")
        return got[0]

    def project(self, frame: Frame, select: Select) -> DataFrame:
        return frame.df.select(*[F.col(frame.aliases[x.out]).alias(x.out) for x in select.items])

    # Relations

    def nest(self, frame: Frame, item: Select) -> None:
        """A related document as a struct, or related documents as a list in order."""
        if (r := frame.collection.relation(item.name)) is None:
            raise QueryError(f"{frame.collection.name} has no relation {item.name}")
        child = self.frame(r.target)
        link = fresh("l")
        child.df = child.df.withColumn(link, F.col(f"`{r.other}`")).where(F.col(link).isNotNull())
        child, order = self.rows(child, item, (link,))
        value = F.struct(*[F.col(child.aliases[x.out]).alias(x.out) for x in item.items])
        by = replace(r, other=link)
        if not r.many:
            frame.put(item.out, F.col(frame.attach(child.df, by, [value])[0]))
            return
        if item.order or item.group_by is not None:
            lists = self.gather(child.df, [link], order, value)
        else:  # in the order of keys, which need no rank
            one = F.struct(F.col(f"`{child.collection.key}`").alias("key"), value.alias("value"))
            lists = child.df.groupBy(link).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["value"]).alias("list"))
        name = frame.attach(lists, by, [F.col("list")])[0]
        frame.put(item.out, F.coalesce(F.col(name), F.array().cast(frame.kind(name))))

    def gather(self, df: DataFrame, keys: list[str], order: list[Column], value: Column) -> DataFrame:
        """One list for each value of keys, in order: a rank is gathered with each element and sorted by."""
        w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)
        ranked = df.withColumn("__rank", F.row_number().over(w)).select(*keys, F.struct(F.col("__rank"), value.alias("value")).alias("__x"))
        return ranked.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("__x")), lambda x: x["value"]).alias("list"))

    # Aggregates

    def _members(self, frame: Frame, t: Target, within: tuple[str, ...], fields: list[str | None] | None = None) -> list[Column | None]:
        """Filters, orders and limits the rows of a target in frame; for each field the column to aggregate, or None to count rows."""
        select = Select(t.host, filter=t.filter, order=tuple(t.order if isinstance(t.order, (list, tuple)) else [t.order] if t.order else ()), limit=t.limit, offset=t.offset)
        values = []
        for name in [t.field] if fields is None else fields:
            value = None
            if name is not None:
                if (found := frame.field(name)) is None:
                    found = frame.aliased(name)
                if not isinstance(found[1], NUMERIC):
                    raise QueryError(f"{name} is no number")
                value = fresh("x")
                frame.df = frame.df.withColumn(value, found[0])
            values.append(value)
        self.rows(frame, select, within)
        return [None if value is None else F.col(value) for value in values]

    def _pool(self, frame: Frame, t: Target, r: Relation) -> str:
        """The column with partial results of a target; all that a selection takes of one target is grouped and joined once."""
        key = _target(t)
        if (key, t.field) not in frame.pooled:
            child = self.frame(r.target)
            link = fresh("l")
            child.df = child.df.withColumn(link, F.col(f"`{r.other}`")).where(F.col(link).isNotNull())
            fields = frame.wanted.get(key) or [t.field]
            values = self._members(child, t, (link,), fields)
            parts = [F.struct(*_partials(value)).alias(f"p{k}") for k, value in enumerate(values)]
            names = frame.attach(child.df.groupBy(link).agg(*parts), replace(r, other=link), [F.col(f"p{k}") for k in range(len(parts))])
            frame.pooled |= {(key, f): name for f, name in zip(fields, names)}
        return frame.pooled[key, t.field]

    def aggregate(self, frame: Frame, item: Aggregate) -> Column:
        """Partial results of each target are joined on and combined, so several targets are pooled."""
        parts, whole = [], True
        for t in item.targets:
            if (r := frame.collection.relation(t.host)) is not None:
                if item.name != "_count" and t.field is None:
                    raise QueryError(f"{item.name} of {t.host} needs a field")
                name = self._pool(frame, t, r)
                parts.append(F.col(name))
                whole &= isinstance(frame.kind(name)["s"].dataType, WHOLE)
            elif t.host == "_version":
                name = self.version(frame, Select("_version", alias=fresh("n")), None)
                parts.append(_array_partials(F.col(name), None))
            elif (found := frame.field(t.host)) is not None and isinstance(found[1], T.ArrayType):
                element = found[1].elementType
                test = _element_test(t.filter, element) if t.filter else None
                order = t.order if isinstance(t.order, str) or t.order is None else None
                a = arrays.prepared(found[0], test, order, t.limit, t.offset)
                number = isinstance(element, NUMERIC)
                if item.name != "_count" and not number:
                    raise QueryError(f"{item.name} needs numbers")
                whole &= item.name == "_count" or isinstance(element, WHOLE)
                parts.append(_array_partials(a, found[1] if number else None))
            else:
                raise QueryError(f"{frame.collection.name} has no {t.host} to aggregate")
        return _combined(item.name, parts, whole)

    # Groups

    def key_column(self, frame: Frame, name: str) -> str:
        if name in frame.base:
            return name
        if (r := frame.collection.relation(name)) is not None:
            if r.many:
                raise QueryError(f"can't group by {name}: it has several documents")
            return r.own
        if (found := frame.collection.relation(name.removesuffix("_id"))) is not None and not found.many:
            return found.own
        if name == "_docID":
            return frame.collection.key
        raise QueryError(f"{frame.collection.name} has no field {name}")

    def group(self, frame: Frame, select: Select, within: tuple[str, ...]) -> Frame:
        """One row for each value of the keys. Aggregates without order or limit are one grouping; the rest is joined to it."""
        own = [self.key_column(frame, g) for g in select.group_by]
        keys = list(dict.fromkeys([*within, *own]))
        named = set(select.group_by) | set(own)
        direct, joined, outs = [], [], []
        nested = {x.out: x for x in select.items if isinstance(x, Select)}
        base = frame.df
        for item in select.items:
            if isinstance(item, Plain):
                if item.name != "__typename" and item.name not in named and item.name.removesuffix("_id") not in named:
                    raise QueryError(f"{item.name} is not a key of the group")
                outs.append((item.out, F.lit(frame.collection.name) if item.name == "__typename" else F.col(f"`{self.key_column(frame, item.name)}`")))
            elif isinstance(item, Aggregate):
                parts, whole = [], True
                for t in item.targets:
                    if t.host != "_group":
                        raise QueryError(f"{item.name} in a group runs over _group, not {t.host}")
                    name = fresh("p")
                    if t.field is not None and t.field.startswith("_") and t.field != "_docID":
                        inner = next((x for x in nested.values() if x.name == "_group" and x.group_by is not None and any(isinstance(y, Aggregate) and y.out == t.field for y in x.items)), None)
                        if inner is None:
                            raise QueryError(f"{t.field} needs a _group with its own groupBy")
                        rows, _ = self.rows(Frame(self, frame.collection, base), replace(inner, limit=None, offset=None), tuple(keys))
                        value = rows.aliases[t.field]
                        sums = rows.df.groupBy(*keys).agg(F.struct(*_partials(F.col(value))).alias(name))
                        joined.append(sums)
                        kind = rows.kind(value)
                    elif t.limit or t.offset or t.order or _has_relation(t.filter, frame.collection):
                        rows = Frame(self, frame.collection, base)
                        value = self._members(rows, t, tuple(keys))[0]
                        joined.append(rows.df.groupBy(*keys).agg(F.struct(*_partials(value)).alias(name)))
                        kind = frame.kind(self.key_column(frame, t.field)) if t.field else T.LongType()
                    else:
                        test = compile_filter(t.filter, frame) if t.filter else None
                        value = None
                        kind = T.LongType()
                        if t.field is not None:
                            value, kind = frame.field(t.field) or frame.aliased(t.field)
                            if not isinstance(kind, NUMERIC):
                                raise QueryError(f"{t.field} is no number")
                        direct.append(F.struct(*_partials(value, test)).alias(name))
                    whole &= isinstance(kind, WHOLE)
                    parts.append(name)
                if item.name != "_count" and any(t.field is None for t in item.targets):
                    raise QueryError(f"{item.name} of _group needs a field")
                outs.append((item.out, _combined(item.name, [F.col(p) for p in parts], whole)))
            elif isinstance(item, Select) and item.name == "_group":
                name = fresh("g")
                inner, order = self.rows(Frame(self, frame.collection, base), item, tuple(keys))
                value = F.struct(*[F.col(inner.aliases[x.out]).alias(x.out) for x in item.items])
                joined.append(self.gather(inner.df, keys, order, value).withColumnRenamed("list", name))
                outs.append((item.out, F.coalesce(F.col(name), F.array().cast(joined[-1].schema[name].dataType))))
            else:
                raise QueryError(f"{item.out} can't be selected in a group")
        if keys:
            df = base.groupBy(*keys).agg(*direct) if direct else base.select(*keys).distinct()
        else:  # one group that holds every document
            df = base.groupBy().agg(*(direct or [F.count("*").alias(fresh("n"))]))
        for right in joined:
            names = {k: fresh("k") for k in keys}
            right = right.withColumnsRenamed(names)
            same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in names.items()], F.lit(True))
            df = df.join(right, same, "left").drop(*names.values())
        out = Frame(self, frame.collection, df)
        out.base = set(keys)
        for alias, value in outs:
            out.put(alias, value)
        return out

    # Versions

    def version(self, frame: Frame, item: Select, cid: str | None) -> str:
        if self.versions is None:
            raise QueryError("no commits are kept")
        commits = self.versions(frame.collection, cid)
        names = [x.name for x in item.items] or ["cid"]
        link = fresh("l")
        df = commits.withColumn(link, F.col("docID"))
        value = F.struct(*[F.col(n).alias(x.out) for n, x in zip(names, item.items)]) if item.items else F.struct(F.col("cid"))
        lists = self.gather(df, [link], [F.desc("height"), F.asc("cid")], value)
        key = frame.collection.key
        name = frame.attach(lists, Relation("_version", "", True, key, link), [F.col("list")])[0]
        frame.put(item.out, F.coalesce(F.col(name), F.array().cast(frame.kind(name))))
        return frame.aliases[item.out]


class _Value:
    """The scope of an array's element: its only field is the element."""

    def __init__(self, value: Column, kind: T.DataType) -> None:
        self.value, self.kind = value, kind

    def field(self, name: str):
        return (self.value, self.kind) if name == "_value" else None

    def is_json(self, name: str) -> bool:
        return False

    def related(self, name: str, condition: dict) -> None:
        return None

    def aliased(self, name: str):
        raise QueryError(f"no alias {name} in an array")


def _element_test(condition: dict, kind: T.DataType):
    return lambda x: compile_filter(_on_value(condition), _Value(x, kind))


def _on_value(condition: dict) -> dict:
    """Operators of an array filter as a filter of its element."""
    out = {}
    for k, v in condition.items():
        if k in ("_and", "_or"):
            out[k] = [_on_value(x) for x in v]
        else:
            out.setdefault("_value", {})[k] = v
    return out


def _has_relation(condition, collection: Collection) -> bool:
    if isinstance(condition, dict):
        return any(k in collection.relations or _has_relation(v, collection) for k, v in condition.items())
    return isinstance(condition, list) and any(_has_relation(x, collection) for x in condition)


def _target(t: Target) -> str:
    return repr((t.host, t.filter, t.order, t.limit, t.offset))


def _partials(value: Column | None, test: Column | None = None) -> list[Column]:
    """n rows, m that are not null, their sum and extremes."""
    if value is None:
        n = F.count(F.when(test, 1)) if test is not None else F.count("*")
        none = F.max(F.lit(None).cast("long"))
        return [n.alias("n"), n.alias("m"), none.alias("s"), none.alias("lo"), none.alias("hi")]
    n = F.count(F.when(test, 1)) if test is not None else F.count("*")
    value = F.when(test, value) if test is not None else value
    return [n.alias("n"), F.count(value).alias("m"), F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi")]


def _array_partials(a: Column, kind: T.ArrayType | None) -> Column:
    n = F.coalesce(F.size(a), F.lit(0)).cast("long")
    if kind is None:
        none = F.lit(None).cast("long")
        return F.struct(n.alias("n"), n.alias("m"), none.alias("s"), none.alias("lo"), none.alias("hi"))
    some = F.filter(F.coalesce(a, F.array().cast(kind)), lambda x: x.isNotNull())
    whole = [(a, kind)]
    return F.struct(n.alias("n"), F.size(some).cast("long").alias("m"), arrays.fold("_sum", whole).alias("s"), arrays.fold("_min", whole).alias("lo"), arrays.fold("_max", whole).alias("hi"))


def _combined(name: str, parts: list[Column], whole: bool) -> Column:
    kind = "long" if whole else "double"
    zero = F.lit(0).cast("long")
    every = lambda f, z: reduce(lambda a, b: a + b, [F.coalesce(p[f], z) for p in parts])
    if name == "_count":
        return every("n", zero)
    if name == "_sum":
        return every("s", zero).cast(kind)
    if name == "_avg":
        m = every("m", zero)
        return F.when(m == 0, 0.0).otherwise(every("s", zero).cast("double") / m)
    if name in ("_min", "_max"):
        ends = [p["lo" if name == "_min" else "hi"].cast(kind) for p in parts]
        return ends[0] if len(ends) == 1 else F.least(*ends) if name == "_min" else F.greatest(*ends)
    raise QueryError(f"unknown aggregate {name}")
