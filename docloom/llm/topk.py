"""Exact top-k by inner product with a pivot-distance index.

Vectors become integers, floor(scale * x), kept as doubles that hold them exactly. A row is keyed by its nearest pivot and
its distance to it, in rings of equal width; rings are cut into blocks of bounded size, whose rows are sorted by distance.
A ring also has the least and greatest distance of its rows to every pivot. For a query q and a ring whose distances to a
pivot lie in [a, b], the triangle inequality bounds |q - y| from below, the pivot that bounds it best counts, and with the
ring's longest vector that bounds the inner product from above. A query first visits the rings with the highest bounds
until they hold enough rows; its k-th best score there is a floor, and in a second round it visits every other ring whose
bound reaches that floor, and of each block only the sorted annulus that can hold a score as high, so nothing is missed.
Rings' figures are at most PIVOTS * RINGS rows of 2 * PIVOTS distances for each length of vector; rows and queries stay
distributed, and the queries that visit a block are dealt into turns as their number grows.
Where vectors have no clusters, distances to pivots are all alike and no bound reaches; then all blocks are visited.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; vectors of different
lengths are not compared; a query's own row is no candidate of it, nor are rows that repeat its id, as an id names one
vector; other repeated rows are candidates each; vectors too long for the index (over FAR) are in every query's way and
are compared in exact arithmetic; a score that no long can hold, among
the k highest of a block, is an error; columns other than the id
and the vector are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .vectors import binary, centres, matrix, nearest, rows_of, sample

PIVOTS, RINGS = 64, 48
#: Rows of a block, and queries of a turn, about.
BLOCK, TURN = 2048, 1 << 15
#: Longer vectors have a ring of their own, with pivot -1.
FAR = 2.0**40


def products(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows that hold integers; of Python integers where a long may be too small."""
    if not len(q) or not len(y):
        return np.zeros((len(q), len(y)), np.int64)
    size = float(np.linalg.norm(q, axis=1).max()) * float(np.linalg.norm(y, axis=1).max()) if max(np.abs(q).max(), np.abs(y).max()) < 1e150 else np.inf
    if size < 2**52:
        return (q @ y.T).astype(np.int64)
    if size < 2**61:
        return q.astype(np.int64) @ y.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    a, b = whole(q), whole(y)
    return np.array([[sum(i * j for i, j in zip(u, v)) for v in b] for u in a], object).reshape(len(q), len(y))


class Index:
    """Pivots and ring width for each length of vector, and with figures() the rings' bounds."""

    def __init__(self, samples: list[np.ndarray], scale: float) -> None:
        self.scale, self.pivots, self.width = scale, {}, {}
        for m in samples:
            x = self.whole(m)
            x = x[self.near(x)]
            if len(x):
                c = centres(x, min(PIVOTS, max(1, len(x) // 32)))
                self.pivots[x.shape[1]] = c
                self.width[x.shape[1]] = max(1e-9, float(np.sqrt(nearest(x, c)[1].max())) * 1.1 / (RINGS - 1))
        self.rings: dict[int, np.ndarray] = {}

    def whole(self, m: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = np.floor(self.scale * m)
        return np.where(np.isinf(x), m, x)  # what overflows was a whole number before

    @staticmethod
    def near(x: np.ndarray) -> np.ndarray:
        return np.abs(x).max(axis=1) * np.sqrt(x.shape[1]) < FAR

    def known(self, n: int) -> tuple[np.ndarray, float]:
        """A length that the sample lacks has one pivot at the origin."""
        return self.pivots.get(n, np.zeros((1, n))), self.width.get(n, 1.0)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """(rows, pivots)"""
        c, _ = self.known(x.shape[1])
        return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pivot, ring and the distances to all pivots."""
        _, width = self.known(x.shape[1])
        far = self.distances(x)
        pivot = far.argmin(axis=1)
        return pivot, np.minimum(RINGS - 1, (far[np.arange(len(x)), pivot] / width).astype(np.int64)), far

    def figures(self, rows: list) -> None:
        """rows: n, pivot, ring, count, norm, blocks, lows, highs."""
        by: dict[int, list] = {}
        for r in sorted(rows):
            by.setdefault(r[0], []).append(r[1:])
        self.rings = {n: np.array([x[:5] for x in v], np.float64) for n, v in by.items()}
        self.spread = {n: (np.array([x[5] for x in v]), np.array([x[6] for x in v])) for n, v in by.items()}

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, rings): no row of the ring has a greater product."""
        r, (low, high) = self.rings[q.shape[1]], self.spread[q.shape[1]]
        near, norm = self.near(q), r[:, 3]
        q = np.where(near[:, None], q, 0.0)
        d, q2 = self.distances(q), (q * q).sum(axis=1)[:, None]
        gap = np.zeros((len(q), len(r)))
        for p in range(d.shape[1]):
            np.maximum(gap, np.maximum(d[:, p, None] - high[None, :, p], low[None, :, p] - d[:, p, None]), out=gap)
        gap = np.maximum(0, gap - 1e-6 * (1 + d.max(axis=1)[:, None] + np.sqrt(q2) + norm))  # for rounding
        bound = np.minimum((q2 + norm**2 - gap * gap) / 2, np.sqrt(q2) * norm) + 1e-9 * (q2 + norm**2) + 1
        return np.where((r[:, 0] < 0)[None, :] | ~near[:, None], np.inf, bound)


def build(df: DataFrame, id_col: str, vector: str, scale: float) -> tuple[Index, DataFrame]:
    """The index, and its rows: n, pivot, ring, id, x (doubles that are integers)."""
    index = Index(sample(df, id_col, vector), scale)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for k, m in rows_of(batch.column("v")):
                for lo in range(0, len(m), 1024):
                    x, own = index.whole(m[lo : lo + 1024]), ids.take(pa.array(k[lo : lo + 1024]))
                    near = index.near(x)
                    with np.errstate(over="ignore", invalid="ignore"):
                        pivot, ring, far = index.place(np.where(near[:, None], x, 0.0))
                    pivot, ring, far = np.where(near, pivot, -1), np.where(near, ring, 0), np.where(near[:, None], far, 0.0)
                    norm = np.where(near, np.sqrt((np.where(near[:, None], x, 0.0) ** 2).sum(axis=1)), 0.0)
                    distance = np.where(near, far[np.arange(len(x)), np.maximum(pivot, 0)], 0.0)
                    yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(x), x.shape[1], np.int32)), "pivot": pa.array(pivot.astype(np.int32)), "ring": pa.array(ring.astype(np.int32)), "far": pa.array(distance), "all": binary(far.astype(np.float32)), "norm": pa.array(norm), "id": own, "x": binary(x)})

    def sum_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A ring's figures over the rows of one task."""
        known: dict[tuple, list] = {}
        for batch in batches:
            key = np.column_stack([batch.column(c).to_numpy() for c in ("n", "pivot", "ring")])
            norm, n = batch.column("norm").to_numpy(), batch.column("count").to_numpy()
            for one in np.unique(key, axis=0):
                k = np.flatnonzero((key == one).all(axis=1))
                low, high = (matrix(batch.column(c).take(pa.array(k)), np.float32) for c in ("low", "high"))
                held = known.get(tuple(one.tolist()))
                now = [int(n[k].sum()), float(norm[k].max()), low.min(axis=0), high.max(axis=0)]
                known[tuple(one.tolist())] = now if held is None else [held[0] + now[0], max(held[1], now[1]), np.minimum(held[2], now[2]), np.maximum(held[3], now[3])]
        if known:
            yield pa.RecordBatch.from_pydict({c: pa.array([k[i] for k in known], pa.int32()) for i, c in enumerate(("n", "pivot", "ring"))} | {"count": pa.array([v[0] for v in known.values()], pa.int64()), "norm": pa.array([v[1] for v in known.values()], pa.float64()), "low": pa.array([v[2].tobytes() for v in known.values()], pa.binary()), "high": pa.array([v[3].tobytes() for v in known.values()], pa.binary())})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    rows = stored(rows.mapInArrow(work, "n int, pivot int, ring int, far double, all binary, norm double, id bigint, x binary"), "rings")
    kinds = "n int, pivot int, ring int, count bigint, norm double, low binary, high binary"
    parts = rows.select("n", "pivot", "ring", F.lit(1).cast("long").alias("count"), "norm", F.col("all").alias("low"), F.col("all").alias("high")).mapInArrow(sum_up, kinds)
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A row for each ring: at most PIVOTS * RINGS for each length of vector.
    got = parts.repartition(spread, "n", "pivot", "ring").mapInArrow(sum_up, kinds).collect()
    index.figures([(r.n, r.pivot, r.ring, r["count"], r.norm, -(-r["count"] // BLOCK), np.frombuffer(r.low, np.float32).astype(np.float64).tolist(), np.frombuffer(r.high, np.float32).astype(np.float64).tolist()) for r in got])
    return index, rows.drop("all", "norm")


def top_k(df: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` the k highest scores, ties to smaller ids."""
    index, rows = build(df, id_col, vector, scale)
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = {(n, int(r[0]), int(r[1])): int(r[4]) for n, v in index.rings.items() for r in v}
    hashed = F.xxhash64("x", "id")

    def blocked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = np.array([blocks[key] for key in zip(*(batch.column(c).to_pylist() for c in ("n", "pivot", "ring")))], np.int64)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("n", "pivot", "ring", "far", "id", "x")} | {"block": pa.array((batch.column("h").to_numpy() % many).astype(np.int32))})

    lists = rows.withColumn("h", hashed).select("n", "pivot", "ring", "far", "id", "x", "h").mapInArrow(blocked, "n int, pivot int, ring int, far double, id bigint, x binary, block int")
    queries = rows.where(F.col("id") % every == 0).select("n", "id", hashed.alias("q"), "x").distinct()
    turns = 1 + queries.count() // TURN
    lists = lists.select("n", "pivot", "ring", "block", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), F.lit(0).alias("kind"), "far", "id", F.lit(0).cast("long").alias("q"), "x")

    def visits(second: bool):
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = batch.column("n").to_numpy()
                for n in np.unique(lengths).tolist():
                    pick = np.flatnonzero(lengths == n)
                    for lo in range(0, len(pick), 256):
                        at = pick[lo : lo + 256]
                        part = batch.take(pa.array(at))
                        r = index.rings[n]
                        bound = index.bounds(matrix(part.column("x")))
                        order = np.argsort(-bound, axis=1, kind="stable")
                        held = np.where(r[order][:, :, 0] < 0, 0, r[order][:, :, 2])
                        seen = np.cumsum(held, axis=1) - held
                        early = np.zeros(bound.shape, bool)
                        np.put_along_axis(early, order, seen < 4 * k + 1, axis=1)  # rings before enough rows were seen
                        go, floor = early, np.full(part.num_rows, np.nan)
                        if second:
                            floor = part.column("floor").to_numpy(zero_copy_only=False)
                            go = ~early & ((bound >= floor[:, None]) | np.isnan(floor)[:, None])
                        i, j = np.nonzero(go)
                        times = r[j, 4].astype(np.int64)
                        i, j = np.repeat(i, times), np.repeat(j, times)
                        block = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                        if len(i):
                            yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(i), n, np.int32)), "pivot": pa.array(r[j, 0].astype(np.int32)), "ring": pa.array(r[j, 1].astype(np.int32)), "block": pa.array(block.astype(np.int32)), "turn": pa.array((part.column("q").to_numpy().view(np.uint64)[i] % np.uint64(turns)).astype(np.int32)), "kind": pa.array(np.ones(len(i), np.int32)), "far": pa.array(floor[i]), "id": part.column("id").take(pa.array(i)), "q": part.column("q").take(pa.array(i)), "x": part.column("x").take(pa.array(i))})

        return work

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block and turn, its rows before the queries that visit it, whose floor is in far."""
        key, held, block = None, [], None
        for batch in batches:
            cols5 = np.column_stack([batch.column(c).to_numpy() for c in ("n", "pivot", "ring", "block", "turn", "kind")])
            edges = [0, *(np.flatnonzero((cols5[1:] != cols5[:-1]).any(axis=1)) + 1).tolist(), len(cols5)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part, now = batch.slice(lo, hi - lo), tuple(cols5[lo, :5].tolist())
                if now != key:
                    key, held, block = now, [], None
                if cols5[lo, 5] == 0:
                    held.append(part)
                elif held:
                    block = block or _Block(index, now[1], held)
                    for s in range(0, part.num_rows, 256):
                        some = part.slice(s, 256)
                        r, v, score = block.visit(some, k)
                        yield pa.RecordBatch.from_pydict({"query_id": some.column("id").take(pa.array(r)), "q": some.column("q").take(pa.array(r)), "vec_id": pa.array(v), "score": pa.array(score, pa.int64())})

    def found(v: DataFrame) -> DataFrame:
        keys = ["n", "pivot", "ring", "block", "turn"]
        return lists.unionByName(v).repartition(parts, *keys).sortWithinPartitions(*keys, "kind", "far", "id").mapInArrow(search, "query_id bigint, q bigint, vec_id bigint, score bigint")

    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    kinds = "n int, pivot int, ring int, block int, turn int, kind int, far double, id bigint, q bigint, x binary"
    first = found(queries.mapInArrow(visits(False), kinds)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = stored(first, "top-first")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("q").alias("of_q"), F.col("score").cast("double").alias("floor"))
    again = queries.join(floors, (F.col("id") == F.col("of")) & (F.col("q") == F.col("of_q")), "left").select("n", "id", "q", "x", F.coalesce("floor", F.lit(float("nan"))).alias("floor"))
    second = found(again.mapInArrow(visits(True), kinds))
    both = first.drop("rank").unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class _Block:
    """Rows of one block by their distance to its pivot."""

    def __init__(self, index: Index, pivot: int, parts: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(parts)
        self.index, self.pivot = index, pivot
        self.far, self.id, self.x = t.column("far").to_numpy(), t.column("id").to_numpy(), matrix(t.column("x"))
        self.norm2 = float((self.x * self.x).sum(axis=1).max()) if pivot >= 0 else 0.0

    def annulus(self, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the rows [lo, hi) that may reach its floor: |q - y|^2 = q^2 + y^2 - 2qy is over (distance to the pivot of q less that of y)^2."""
        none, every = np.zeros(len(q), np.int64), np.full(len(q), len(self.far))
        sure = ~np.isnan(floor) & self.index.near(q)
        if self.pivot < 0 or not sure.any():
            return none, every
        q = np.where(sure[:, None], q, 0.0)
        d, q2 = self.index.distances(q)[:, self.pivot], (q * q).sum(axis=1)
        reach = np.sqrt(np.maximum(0, q2 + self.norm2 - 2 * np.where(sure, floor, 0) + 1e-9 * (q2 + self.norm2) + 1)) + 1e-6 * (1 + d + np.sqrt(q2) + math.sqrt(self.norm2))
        return np.where(sure, np.searchsorted(self.far, d - reach), none), np.where(sure, np.searchsorted(self.far, d + reach, "right"), every)

    def visit(self, part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Row of the query, vec_id and score of each query's k best rows here."""
        q, own = matrix(part.column("x")), part.column("id").to_numpy()
        lo, hi = self.annulus(q, part.column("far").to_numpy(zero_copy_only=False))
        rows, ids, scores = [], [], []
        a, b = int(lo.min()), int(hi.max())
        p = products(q, self.x[a:b]) if b > a else None
        for r in range(len(q)):
            if hi[r] > lo[r]:
                at = np.flatnonzero(self.id[lo[r] : hi[r]] != own[r]) + lo[r]
                score, who = p[r, at - a], self.id[at]
                if len(score) > 4 * k and score.dtype != object:
                    some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                    score, who = score[some], who[some]
                for s, v in sorted(zip(score.tolist(), who.tolist()), key=lambda x: (-x[0], x[1]))[:k]:
                    rows.append(r)
                    ids.append(v)
                    scores.append(s)
        return np.array(rows, np.int64), np.array(ids, np.int64), scores
