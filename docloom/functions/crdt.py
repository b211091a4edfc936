"""Merge rules over a log of deltas, as grouped folds that give the same in any order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lww(value: Column, height: Column) -> Column:
    """The value with the greatest height; of equal heights that whose encoding is greatest. A null value may win."""
    return F.max(F.struct(height.alias("height"), F.coalesce(F.to_json(F.struct(value.alias("v"))), F.lit("")).alias("encoded"), value.alias("value")))["value"]


def pn_counter(delta: Column) -> Column:
    return F.sum(delta)


def p_counter(delta: Column) -> Column:
    """A counter that may only grow: a negative delta is an error."""
    return F.sum(F.when(delta < 0, F.raise_error(F.lit("a counter that only grows got a negative delta")).cast("double")).otherwise(delta))


def deleted(status: Column) -> Column:
    """Once deleted, always deleted."""
    return F.coalesce(F.bool_or(status == "deleted"), F.lit(False))


def fold(commits: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """State from field commits: _docID, each field, _deleted.

    commits: docID, fieldName ("_C" for the document's own), height, delta (JSON text of the value), status.
    fields: name -> (merge type, Spark type)."""
    columns = []
    for name, (merge, kind) in fields.items():
        mine = F.col("fieldName") == name
        if merge == "lww":
            value = F.max(F.when(mine, F.struct("height", F.coalesce("delta", F.lit("")).alias("encoded"), "delta")))["delta"]
            value = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), f"v {kind}")["v"]
        else:
            delta = F.when(mine, F.col("delta").cast(kind))
            value = F.coalesce(pn_counter(delta) if merge == "pncounter" else p_counter(delta), F.lit(0)).cast(kind)
        columns.append(value.alias(name))
    gone = deleted(F.when(F.col("fieldName") == "_C", F.col("status")))
    return commits.groupBy(F.col("docID").alias("_docID")).agg(*columns, gone.alias("_deleted"))
