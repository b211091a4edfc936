"""Aggregates over inline arrays, and similarity of vectors, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import NUMERIC, WHOLE, QueryError


def prepared(array: Column, test: Callable[[Column], Column] | None, order: str | None, limit: int | None, offset: int | None) -> Column:
    """The elements that pass, in order, without those before offset and after limit. Nulls come first ascending."""
    if test is not None:
        array = F.filter(array, test)
    if order:
        array = F.sort_array(array, order.upper() == "ASC")
    if limit or offset:
        start = (offset or 0) + 1
        array = F.slice(array, start, limit or 2**31 - 1 - start)
    return array


def fold(name: str, arrays: list[tuple[Column, T.DataType]]) -> Column:
    """One aggregate over the pooled elements of all arrays. Null elements count, but add nothing and have no extremes."""
    if name == "_count":
        sizes = [F.coalesce(F.size(a), F.lit(0)) for a, _ in arrays]
        return sum(sizes[1:], sizes[0]).cast("long")
    kinds = [k.elementType for _, k in arrays]
    if not all(isinstance(k, NUMERIC) for k in kinds):
        raise QueryError(f"{name} needs numbers")
    whole = all(isinstance(k, WHOLE) for k in kinds)
    to = "array<bigint>" if whole else "array<double>"
    empty = F.array().cast(to)
    pooled = [F.coalesce(a.cast(to), empty) for a, _ in arrays]
    x = F.filter(F.concat(*pooled) if len(pooled) > 1 else pooled[0], lambda v: v.isNotNull())
    zero = F.lit(0).cast("long") if whole else F.lit(0.0)
    if name == "_sum":
        return F.aggregate(x, zero, lambda a, v: a + v)
    if name == "_avg":
        return F.when(F.size(x) == 0, 0.0).otherwise(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x))
    if name in ("_min", "_max"):
        return F.array_min(x) if name == "_min" else F.array_max(x)
    raise QueryError(f"unknown aggregate {name}")


def similarity(vector: Column, kind: T.DataType, other: list[float]) -> Column:
    """The dot product; 0 for a null vector, an error where lengths differ."""
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, NUMERIC):
        raise QueryError("_similarity needs a list of numbers")
    fixed = F.array(*[F.lit(float(x)) for x in other])
    dot = F.aggregate(F.zip_with(vector, fixed, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    wrong = F.raise_error(F.lit(f"vectors must have {len(other)} elements")).cast("double")
    return F.when(vector.isNull(), 0.0).when(F.size(vector) != len(other), wrong).otherwise(dot)


def cosine(vector: Column, other: list[float]) -> Column:
    """The dot product over both lengths."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return similarity(vector, T.ArrayType(T.DoubleType()), other) / (norm * F.lit(sum(x * x for x in other) ** 0.5))
