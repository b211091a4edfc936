"""Creating, updating, deleting and upserting documents, as new states of a table."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import DELETED, Collection
from ..types import QueryError, check_value, spark_type

PREFIX = "bae-"


def content_id(collection: str, columns: list[str]) -> Column:
    """The id of a document by what it holds in these columns: the same for the same content."""
    said = F.to_json(F.struct(F.lit(collection).alias("__collection"), *[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false", "timeZone": "UTC"})
    h = F.sha1(said.cast("binary"))
    return F.concat(F.lit(PREFIX), F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def checked(c: Collection, doc: dict, complete: bool) -> dict:
    """Stored values of a document, with defaults where complete."""
    out = {}
    for name, value in doc.items():
        r = c.relation(name)
        name = r.own if r is not None and r.own != c.key else name
        if name not in c.fields:
            raise QueryError(f"{c.name} has no field {name}")
        f = c.fields[name]
        if f.kind == "JSON" and value is not None and not isinstance(value, str):
            value = json.dumps(value)
        out[name] = check_value(name, f.kind, value, f.size)
    if complete:
        for name, f in c.fields.items():
            out.setdefault(name, None if f.default is None else check_value(name, f.kind, f.default, f.size))
    return out


def create(c: Collection, df: DataFrame, docs: list[dict]) -> tuple[DataFrame, list[str], DataFrame]:
    """The new documents, their ids, and docID, fieldName of what each sets."""
    rows, given = [], []
    for k, doc in enumerate(docs):
        rows.append({"__n": k, DELETED: False, **checked(c, doc, True)})
        given.append(set(checked(c, doc, False)))
    schema = df.schema
    names = [n for n in schema.names if n != c.key]
    text = [f for f in names if f in c.fields and c.fields[f].kind == "DateTime"]
    plain = ", ".join(f"`{n}` {'string' if n in text else schema[n].dataType.simpleString()}" for n in names)
    new = df.sparkSession.createDataFrame([(r["__n"], *(r.get(n) for n in names)) for r in rows], f"__n int, {plain}")
    for name in text:
        new = new.withColumn(name, F.to_timestamp(name))
    new = new.withColumn(c.key, content_id(c.name, [n for n in names if n != DELETED]))
    ids = [x for _, x in sorted((r["__n"], r[c.key]) for r in new.select("__n", c.key).collect())]  # as many as the request has
    if len(set(ids)) < len(ids) or not df.join(new.select(c.key), c.key, "left_semi").isEmpty():
        raise QueryError("a document with this id exists")
    said = [(ids[k], n) for k, r in enumerate(rows) for n in c.fields if r.get(n) is not None or n in given[k]]
    return new.select(*schema.names), ids, df.sparkSession.createDataFrame(said, "docID string, fieldName string")


def unique(df: DataFrame, names: list[str]) -> None:
    """An error if two documents have equal values in all names."""
    some = df.where(~F.col(DELETED)).dropna(how="all", subset=names)
    if not some.groupBy(*names).count().where("count > 1").isEmpty():
        raise QueryError(f"values of {', '.join(names)} must be unique")


def still_unique(c: Collection, changed: DataFrame, others: DataFrame, names: list[str], error: str) -> None:
    """An error if a changed document has the values of another one in all names; others are looked up by these values only."""
    some = changed.where(~F.col(DELETED)).dropna(how="all", subset=names).select(c.key, *names)
    twice = not some.groupBy(*names).count().where("count > 1").isEmpty()
    same = reduce(lambda a, b: a & b, [some[n].eqNullSafe(others[n]) for n in names])
    if twice or not others.where(~F.col(DELETED)).join(some, same & (some[c.key] != others[c.key]), "left_semi").isEmpty():
        raise QueryError(error)


def update(c: Collection, df: DataFrame, match, patch: dict) -> DataFrame:
    """The documents with the fields of patch set where match holds; counters add instead."""
    values = checked(c, patch, False)
    new = {}
    for name, value in values.items():
        f = c.fields[name]
        kind = df.schema[name].dataType
        if f.merge != "lww":
            if f.merge == "pcounter" and value is not None and value < 0:
                raise QueryError(f"{name} may only grow")
            changed = F.coalesce(F.col(name), F.lit(0)) + F.lit(value)
        elif isinstance(value, list):
            changed = F.array(*[F.lit(x) for x in value])
        else:
            changed = F.to_timestamp(F.lit(value)) if f.kind == "DateTime" else F.lit(value)
        new[name] = F.when(match, changed.cast(kind)).otherwise(F.col(name))
    return df.withColumns(new)


def patched(c: Collection, patch: dict, df: DataFrame) -> dict[str, Column]:
    """Of a patch the values that its commits hold: of a counter what is added, else what is set."""
    out = {}
    for name, value in checked(c, patch, False).items():
        if c.fields[name].merge == "lww":
            out[name] = F.col(name)
        else:
            out[name] = F.lit(value).cast(df.schema[name].dataType)
    return out


def delete(df: DataFrame, match) -> DataFrame:
    """The documents with those that match marked deleted."""
    return df.withColumn(DELETED, F.col(DELETED) | match)


def schema_of(c: Collection) -> str:
    return ", ".join([f"`{c.key}` string", *[f"`{n}` {spark_type(f.kind).simpleString()}" for n, f in c.fields.items()], f"{DELETED} boolean"])
