"""Field kinds of the schema language, and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Scalar kinds of the schema language.
SCALARS = {
    "ID": T.StringType(), "Boolean": T.BooleanType(), "Int": T.LongType(), "Float": T.DoubleType(), "Float64": T.DoubleType(),
    "Float32": T.FloatType(), "DateTime": T.TimestampType(), "String": T.StringType(), "Blob": T.StringType(), "JSON": T.StringType(),
}
LISTS = ("Boolean", "Int", "Float", "Float64", "Float32", "String")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: What a merge type may be declared on.
COUNTERS = ("Int", "Float", "Float64", "Float32")
_BLOB = re.compile(r"[0-9a-fA-F]+")


class SchemaError(ValueError):
    """A schema that can't be."""


class QueryError(ValueError):
    """A query that the collections don't allow."""


def spark_type(kind: str) -> T.DataType:
    """The Spark type of a scalar kind, or of a list such as [Int] or [Int!]."""
    if kind.startswith("["):
        inner = kind[1:-1]
        name = inner.removesuffix("!")
        if name not in LISTS:
            raise SchemaError(f"no lists of {name}")
        return T.ArrayType(SCALARS[name], not inner.endswith("!"))
    if kind.endswith("!"):
        raise SchemaError(f"fields are always nullable: {kind}")
    if kind not in SCALARS:
        raise SchemaError(f"unknown kind: {kind}")
    return SCALARS[kind]


def is_scalar(kind: str) -> bool:
    return kind.strip("[]!") in SCALARS


def check_value(name: str, kind: str, value, size: int | None = None):
    """A value as it is stored, or an error: whole numbers are cut to Int, blobs must be hexadecimal, lists may have a fixed size."""
    if value is None:
        return None
    if kind.startswith("["):
        inner = kind[1:-1]
        items = [check_value(name, inner.removesuffix("!"), x) for x in value]
        if inner.endswith("!"):
            zero = {"Boolean": False, "String": "", "Int": 0}.get(inner[:-1], 0.0)
            items = [zero if x is None else x for x in items]
        if size is not None and len(items) != size:
            raise QueryError(f"{name} must have {size} elements, not {len(items)}")
        return items
    if kind == "Int":
        return int(value)
    if kind in ("Float", "Float64", "Float32"):
        return float(value)
    if kind == "Boolean" and not isinstance(value, bool):
        raise QueryError(f"{name} must be a boolean")
    if kind == "Blob" and not _BLOB.fullmatch(str(value)):
        raise QueryError(f"{name} must be hexadecimal")
    return value
