"""Connected components of a link table by alternating large-star and small-star steps.

Links stay distributed; each step is a minimum over neighbours and a join, and its result is written to the shared
folder, so that lineage stays short. The number of steps grows with the logarithm of the number of nodes. No more than
SMALL links, which are 16 bytes each, are joined in one task instead, with the same result."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Links that one task takes, at most.
SMALL = 1 << 20


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each can reach."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        nodes, roots = _roots(*(np.concatenate(x) for x in zip(*held)))
        for lo in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[lo : lo + (1 << 16)]), "root": pa.array(roots[lo : lo + (1 << 16)])})


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root for every node with a link to another: root is the least node it can reach."""
    e = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "links")
    if e.count() <= SMALL:
        return stored(e.coalesce(1).mapInArrow(_joined, "node bigint, root bigint"), "roots")
    while True:
        least = e.union(e.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        both = e.union(e.select("v", "u")).where("v > u")
        large = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(e.join(least, "u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = stored(small.where("u != v").distinct(), "links")
        # Done when all are stars: no node has two links down, and none that has one is the end of another.
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
