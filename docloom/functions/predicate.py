"""Filters as two-valued columns.

Every leaf is true or false and never null, so that negation is plain negation: unlike in SQL, null is unequal to 5."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import NUMERIC, QueryError



class Scope(Protocol):
    """Where a filter finds what its keys name."""

    def field(self, name: str) -> tuple[Column, T.DataType] | None: ...

    def is_json(self, name: str) -> bool: ...

    def related(self, name: str, condition: dict) -> Column | None: ...

    def aliased(self, name: str) -> tuple[Column, T.DataType]: ...


def _false(c: Column, loose: bool = False) -> Column:
    """Never null. Where null counts as false anyhow, as under a plain filter, the test stays as it is, so that it reaches the scan."""
    return c if loose else F.coalesce(c, F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def compile_filter(condition: dict | None, scope: Scope, loose: bool = False) -> Column:
    """All keys of a condition hold. loose: the column may be null where it is false."""
    if not condition:
        return F.lit(True)
    parts = []
    for key, value in condition.items():
        if key == "_and":
            parts.append(_all([compile_filter(x, scope, loose) for x in value]) if value is not None else F.lit(True))
        elif key == "_or":
            parts.append(_any([compile_filter(x, scope, loose) for x in value]) if value is not None else F.lit(True))
        elif key == "_not":
            parts.append(~compile_filter(value, scope))
        elif key == "_alias":
            parts += [leaf(*scope.aliased(name), ops, loose) for name, ops in value.items()]
        elif (related := scope.related(key, value)) is not None:
            parts.append(related)
        elif (found := scope.field(key)) is not None:
            parts.append(json_leaf(found[0], [], value) if scope.is_json(key) else leaf(*found, value, loose))
        else:
            raise QueryError(f"unknown field in filter: {key}")
    return _all(parts)


def leaf(d: Column, kind: T.DataType, ops, loose: bool = False) -> Column:
    """A block of operators on one value."""
    if not isinstance(ops, dict):
        raise QueryError(f"a filter needs an operator: {ops!r}")
    return _all([operator(d, kind, op, c, loose) for op, c in ops.items()])


def _literal(c, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(c, str):
        at = F.to_timestamp(F.lit(c))
        return at.cast(kind) if isinstance(kind, T.TimestampNTZType) else at
    if isinstance(c, list):
        return F.array(*[F.lit(x) for x in c])
    return F.lit(c)


def _comparable(kind: T.DataType, c) -> bool:
    """Values of unlike kinds are unequal, and neither is greater."""
    if c is None:
        return True
    if isinstance(c, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(c, (int, float)):
        return isinstance(kind, NUMERIC)
    if isinstance(c, str):
        return isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType))
    return True


def operator(d: Column, kind: T.DataType, op: str, c, loose: bool = False) -> Column:
    if op == "_and":
        return _all([leaf(d, kind, x, loose) for x in c]) if c is not None else F.lit(True)
    if op == "_or":
        return _any([leaf(d, kind, x, loose) for x in c]) if c is not None else F.lit(True)
    if op == "_not":
        return ~leaf(d, kind, c)
    if op == "_eq":
        if not _comparable(kind, c):
            return F.lit(False)
        return d.isNull() if c is None else d.eqNullSafe(_literal(c, kind))
    if op == "_ne":
        return ~operator(d, kind, "_eq", c)
    if op == "_in":
        c = c or []
        same = [x for x in c if x is not None and _comparable(kind, x)]
        hits = [_false(d.isin([_literal(x, kind) for x in same]), loose)] if same else []
        return _any(hits + [d.isNull()] * (None in c))
    if op == "_nin":
        return ~operator(d, kind, "_in", c)
    if op in ("_gt", "_ge", "_lt", "_le"):
        if c is None:
            return {"_gt": d.isNotNull(), "_ge": F.lit(True), "_lt": F.lit(False), "_le": d.isNull()}[op]
        if not _comparable(kind, c):
            return F.lit(False)
        x = _literal(c, kind)
        return _false({"_gt": d > x, "_ge": d >= x, "_lt": d < x, "_le": d <= x}[op], loose)
    if op in ("_like", "_ilike"):
        return like(d, kind, c, op == "_ilike", loose)
    if op in ("_nlike", "_nilike"):
        return ~like(d, kind, c, op == "_nilike")
    if op in ("_any", "_all", "_none"):
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        if op == "_any":
            return _false(F.exists(d, lambda x: leaf(x, kind.elementType, c)))
        return _false(F.forall(d, lambda x: leaf(x, kind.elementType, c) if op == "_all" else ~leaf(x, kind.elementType, c)))
    raise QueryError(f"unknown operator {op}")


def like(d: Column, kind: T.DataType, pattern: str | None, fold: bool = False, loose: bool = False) -> Column:
    """A % at an end is anything, one inner % too if it is the only one; all else is literal."""
    if pattern is None:
        raise QueryError("_like needs a pattern")
    if not isinstance(kind, T.StringType):
        return F.lit(False)
    if fold:
        d, pattern = F.lower(d), pattern.lower()
    if len(pattern) < 2:
        return _false(d == pattern, loose)
    head, tail = pattern.startswith("%"), pattern.endswith("%") and len(pattern) > 1
    body = pattern[head : len(pattern) - tail]
    if head and tail:
        return _false(F.contains(d, F.lit(body)), loose)
    if head:
        return _false(F.endswith(d, F.lit(body)), loose)
    if tail:
        return _false(F.startswith(d, F.lit(body)), loose)
    ends = pattern.split("%")
    if len(ends) == 2:
        return _false(F.startswith(d, F.lit(ends[0])) & F.endswith(d, F.lit(ends[1])), loose)
    return _false(d == pattern, loose)


def json_leaf(text: Column, path: list[str], ops) -> Column:
    """Operators on the value at a path of JSON text. A missing key satisfies nothing but what holds for null, and never _ne."""
    value = F.try_parse_json(text)
    at = "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in path)
    here = F.try_variant_get(value, at, "variant") if path else value
    kind = F.coalesce(F.schema_of_variant(here), F.lit("VOID"))
    missing, void = (here.isNull() if path else F.lit(False)), here.isNull() | _false(F.is_variant_null(here))
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, at, "double"))
    string = F.when(kind == "STRING", F.try_variant_get(value, at, "string"))
    truth = F.when(kind == "BOOLEAN", F.try_variant_get(value, at, "boolean"))

    def typed(c) -> tuple[Column, T.DataType]:
        if isinstance(c, bool):
            return truth, T.BooleanType()
        if isinstance(c, int) and 2**53 <= abs(c) < 10**27:  # more digits than a double has
            return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, at, "decimal(38,10)")), T.DecimalType(38, 10)
        return (number, T.DoubleType()) if isinstance(c, (int, float)) else (string, T.StringType())

    def equal(c) -> Column:
        if c is None:
            return void
        if isinstance(c, (dict, list)):
            import json

            return _false(F.to_json(here) == F.to_json(F.parse_json(F.lit(json.dumps(c)))))
        return operator(*typed(c), "_eq", c)

    parts = []
    for op, c in ops.items():
        if op == "_and":
            parts.append(_all([json_leaf(text, path, x) for x in c]))
        elif op == "_or":
            parts.append(_any([json_leaf(text, path, x) for x in c]))
        elif op == "_not":
            parts.append(~json_leaf(text, path, c))
        elif op == "_eq":
            parts.append(equal(c))
        elif op == "_ne":
            parts.append(~missing & ~equal(c))
        elif op == "_in":
            parts.append(_any([equal(x) for x in c]))
        elif op == "_nin":
            parts.append(~missing & ~_any([equal(x) for x in c]))
        elif op in ("_gt", "_ge", "_lt", "_le"):
            parts.append({"_gt": ~void, "_ge": F.lit(True), "_lt": F.lit(False), "_le": void}[op] if c is None else operator(*typed(c), op, c))
        elif op in ("_like", "_ilike"):
            parts.append(like(string, T.StringType(), c, op == "_ilike"))
        elif op in ("_nlike", "_nilike"):
            parts.append(~missing & ~like(string, T.StringType(), c, op == "_nilike"))
        elif op in ("_any", "_all", "_none"):
            items = F.when(kind.startswith("ARRAY"), F.transform(F.try_variant_get(value, at, "array<variant>"), lambda v: F.to_json(v)))
            test = lambda x: json_leaf(x, [], c)
            parts.append(_false(F.exists(items, test) if op == "_any" else F.forall(items, test if op == "_all" else lambda x: ~test(x))))
        elif op.startswith("_"):
            raise QueryError(f"unknown operator {op}")
        else:
            parts.append(json_leaf(text, [*path, op], c))
    return _all(parts)
