"""Merging a stream of commits into document state.

Merge rules commute, so late commits need no watermark: a late register of low height loses, a late counter delta
adds. State is what the fold gives for each document and field, and the cids that were seen, as a commit may come
more than once and counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_counters(commits: DataFrame, kind: str = "double") -> DataFrame:
    """docID, fieldName, value from a stream or table of deltas, in update mode."""
    return commits.dropDuplicates(["cid"]).groupBy("docID", "fieldName").agg(F.sum(F.col("delta").cast(kind)).alias("value"))


def merge_registers(commits: DataFrame) -> DataFrame:
    """docID, fieldName, delta of the winning commit, from a stream or table, in update mode."""
    best = F.max(F.struct("height", F.coalesce("delta", F.lit("")).alias("encoded"), "delta"))
    return commits.groupBy("docID", "fieldName").agg(best["delta"].alias("delta"))
