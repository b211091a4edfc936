"""Embedding near-duplicates by product quantisation.

Vectors of length 1 lie in coarse inverted lists, each with the code of its residual, one number for each subspace,
and the length of what the code leaves out. A vector probes every list whose cell can hold a neighbour: a neighbour
at distance r or less can be in another cell only if the plane halfway between the two centres parts them, and then one of
the two is at most r / 2 from it. Both ends visit, so these probes suffice at any length of vector and in any directions.
In a list, products with codes are sums of table entries; with the angle between a vector and its code they bound the
angle to the vector itself, and a pair whose bound is over the limit can't be a link; the others get an exact cosine in
double precision.

Equal vectors are one class with a weight, so copies are counted and never paired. The number of lists grows with the
square root of the table, up to LISTS; lists are cut into blocks of bounded size, and a block's visitors into as many turns as the table's
size asks for. What leaves a block is counts and, of its links, a spanning forest.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have 0 links and are their
own component; so have rows with a null id, whose component is null; vectors of different lengths don't link; rows
that repeat an id are vectors of their own for n_links and one node for components; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .vectors import binary, centres, matrix, nearest, rows_of, sample

LISTS, PARTS, CODES = 1024, 8, 32
#: There are as many lists as the square root of the number of vectors has times ROOT: a row is sent to a share of all lists,
#: so more lists are more rows sent, and fewer are more pairs compared.
ROOT = 8
#: Vectors of a block, and of the table for each turn, about.
BLOCK, TURN = 4096, 1 << 16


class Quantiser:
    """Coarse centres and codebooks for each length of vector."""

    def __init__(self, samples: list[np.ndarray], least: float, rows: int) -> None:
        self.least, self.reach = least, math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
        self.models: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        self.between: dict[int, np.ndarray] = {}
        for m in samples:
            size = np.linalg.norm(m, axis=1)
            x = m[(size > 0) & np.isfinite(size)] / size[(size > 0) & np.isfinite(size), None]
            if len(x):
                c = centres(x, max(1, min(LISTS, math.isqrt(rows) // ROOT, len(x) // 16)))
                rest = x - c[nearest(x, c)[0]]
                self.models[x.shape[1]] = c, [centres(p, CODES) for p in np.array_split(rest, min(PARTS, x.shape[1]), axis=1)]
                half = (c * c).sum(axis=1) / 2
                self.between[x.shape[1]] = np.sqrt(np.maximum(0, 2 * (half[:, None] + half[None, :] - c @ c.T)))

    def model(self, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """A length that the sample lacks has one list, and codes that say nothing."""
        return self.models.get(n) or (np.zeros((1, n)), [np.zeros((1, p.size)) for p in np.array_split(np.zeros(n), min(PARTS, n))])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code."""
        c, books = self.model(x.shape[1])
        cell, _ = nearest(x, c)
        rest = x - c[cell]
        code = np.zeros((len(x), len(books)), np.uint8)
        for i, p in enumerate(np.array_split(rest, len(books), axis=1)):
            code[:, i], _ = nearest(p, books[i])
        return cell, code

    def probes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """(rows, cells): which cells a row visits."""
        c, _ = self.model(x.shape[1])
        if len(c) == 1:
            return np.ones((len(x), 1), bool)
        far = (c * c).sum(axis=1) / 2 - x @ c.T
        gap = far - far[np.arange(len(x)), cell][:, None]
        return (gap <= (self.reach / 2 + 1e-9) * self.between[x.shape[1]][cell] + 1e-9) | (np.arange(len(c))[None, :] == cell[:, None])

    def floors(self, x: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """For each member of a cell the least product with its code that a link of it can have.

        Angles between directions obey the triangle inequality: a vector within the limit of a member is within the
        limit and the angle between member and code of the code."""
        c, books = self.model(x.shape[1])
        near = c[cell] + np.concatenate([b[code[:, i]] for i, b in enumerate(books)], axis=1)
        size = np.linalg.norm(near, axis=1)
        off = np.arccos(np.clip((near * x).sum(axis=1) / np.maximum(size, 1e-12), -1, 1))
        return size * np.cos(np.minimum(math.pi, math.acos(min(1.0, self.least)) + off)) - 1e-4

    def products(self, q: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """(members, queries): table products of each query with each code of a cell."""
        c, books = self.model(q.shape[1])
        out = np.repeat((q @ c[cell]).astype(np.float32)[None, :], len(code), axis=0)
        for i, p in enumerate(np.array_split(q, len(books), axis=1)):
            out += np.take((books[i] @ p.T).astype(np.float32), code[:, i], axis=0)
        return out


def links(df: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = np.float64 if df.schema[vector].dataType.elementType.typeName() == "double" else np.float32  # as they came
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), F.col("v")))
    rows = rows.withColumn("ok", F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    classes = stored(rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v")), "vector-classes")
    many = classes.count()
    quantiser = Quantiser(sample(classes, "id", "v"), least, many)
    turns = 1 + many // TURN

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, m in rows_of(batch.column("v")):
                x = _unit(m)
                cell, code = quantiser.encode(x)
                at = pa.array(k)
                yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(x), x.shape[1], np.int32)), "cell": pa.array(cell.astype(np.int32)), "h1": batch.column("h1").take(at), "h2": batch.column("h2").take(at), "weight": batch.column("weight").take(at), "code": binary(code), "x": binary(m.astype(raw))})

    coded = stored(classes.select("h1", "h2", "weight", "v").mapInArrow(encode, "n int, cell int, h1 bigint, h2 bigint, weight bigint, code binary, x binary"), "codes")
    # As many figures as there are lists: at most LISTS for each length of vector.
    blocks = {(r.n, r.cell): -(-r["count"] // BLOCK) for r in coded.groupBy("n", "cell").count().collect()}

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row as a member of its own block, in all its turns, and as a query in one turn of every block of the lists it probes."""
        names = ["h1", "h2", "weight", "code", "x"]
        for batch in batches:
            n = batch.column("n").to_numpy()
            for size in np.unique(n).tolist():
                at = np.flatnonzero(n == size)
                for lo in range(0, len(at), 1024):
                    part = batch.take(pa.array(at[lo : lo + 1024]))
                    cell, x = part.column("cell").to_numpy(), _unit(matrix(part.column("x"), raw).astype(np.float64))
                    own = part.column("h1").to_numpy().view(np.uint64) % np.array([blocks[size, c] for c in cell.tolist()], np.uint64)
                    i, c = np.nonzero(quantiser.probes(x, cell))
                    times = np.array([blocks.get((size, k), 0) for k in c.tolist()], np.int64)
                    i, c = np.repeat(i, times), np.repeat(c, times)
                    block = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                    mine = c == cell[i]
                    keep = ~mine | (block <= own[i])  # in its own list a row looks back only
                    i, c, block = i[keep], c[keep], block[keep]
                    own, all_turns, member = own.astype(np.int64), np.tile(np.arange(turns), len(x)), np.repeat(np.arange(len(x)), turns)
                    turn = (part.column("h2").to_numpy().view(np.uint64) % np.uint64(turns)).astype(np.int64)
                    every = np.concatenate([member, i])
                    made = {"cell": np.concatenate([cell[member], c]), "block": np.concatenate([own[member], block]), "turn": np.concatenate([all_turns, turn[i]]), "kind": np.repeat([0, 1], [len(member), len(i)]), "home": own[every], "home_cell": cell[every]}
                    out = {"n": pa.array(np.full(len(every), size, np.int32))} | {k: pa.array(v.astype(np.int32)) for k, v in made.items()}
                    yield pa.RecordBatch.from_pydict(out | {k: part.column(k).take(pa.array(every)) for k in names})

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block, members first -> counts (h1, h2, links) and forest edges (h1, h2, to1, to2)."""
        key, block = None, None
        for batch in batches:
            k5 = np.column_stack([batch.column(c).to_numpy() for c in ("n", "cell", "block", "turn", "kind")])
            edges = [0, *(np.flatnonzero((k5[1:] != k5[:-1]).any(axis=1)) + 1).tolist(), len(k5)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part, now = batch.slice(lo, hi - lo), tuple(k5[lo, :4].tolist())
                if now != key:
                    if block:
                        yield from block.rest()
                    key, block = now, _Block(quantiser, now, raw)
                if k5[lo, 4] == 0:
                    block.add(part)
                else:
                    for s in range(0, part.num_rows, 512):
                        yield from block.visit(part.slice(s, 512))
        if block:
            yield from block.rest()

    placed = coded.mapInArrow(places, "n int, cell int, block int, turn int, kind int, home int, home_cell int, h1 bigint, h2 bigint, weight bigint, code binary, x binary")
    placed = placed.repartition(parts, "n", "cell", "block", "turn").sortWithinPartitions("n", "cell", "block", "turn", "kind")
    found = stored(placed.mapInArrow(search, "h1 bigint, h2 bigint, to1 bigint, to2 bigint, links bigint"), "links-found")
    counts = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    ids = classes.select("h1", "h2", "id")
    forest = found.where("to1 is not null").select("h1", "h2", "to1", "to2").distinct().join(ids, ["h1", "h2"]).select(F.col("id").alias("a"), F.col("to1").alias("h1"), F.col("to2").alias("h2")).join(ids, ["h1", "h2"]).select("a", F.col("id").alias("b"))
    roots = components(forest)
    known = classes.select("h1", "h2", "id", "weight").join(counts, ["h1", "h2"], "left").join(roots, F.col("id") == F.col("node"), "left")
    known = known.select("h1", "h2", F.coalesce("root", "id").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    keyed = rows.select("vec_id", F.when(F.col("ok"), F.col("h1")).alias("h1"), F.when(F.col("ok"), F.col("h2")).alias("h2"))
    out = keyed.join(known, ["h1", "h2"], "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; sizes neither overflow nor vanish when squared."""
    x = m / np.abs(m).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Block:
    """The members of a block, and what the queries that visit it find."""

    def __init__(self, quantiser: Quantiser, key: tuple[int, int, int, int], raw: type) -> None:
        self.quantiser, self.key, self.raw, self.parts = quantiser, key, raw, []
        self.ready = False

    def add(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def _open(self) -> None:
        t = pa.Table.from_batches(self.parts)
        self.h1, self.h2, self.weight = (t.column(c).to_numpy() for c in ("h1", "h2", "weight"))
        self.code, self.x = matrix(t.column("code"), np.uint8), _unit(matrix(t.column("x"), self.raw).astype(np.float64))
        self.floor = self.quantiser.floors(self.x, self.key[1], self.code).astype(np.float32)
        self.visits = self.quantiser.probes(self.x, np.full(len(self.x), self.key[1]))
        self.links, self.label = np.zeros(len(self.h1), np.int64), np.arange(len(self.h1))
        self.ready = True

    def visit(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        if not self.ready:
            self._open()
        _, cell, block, _ = self.key
        q, h1, h2, weight = _unit(matrix(part.column("x"), self.raw).astype(np.float64)), *(part.column(c).to_numpy() for c in ("h1", "h2", "weight"))
        maybe = (self.quantiser.products(q, cell, self.code) >= self.floor[:, None]).T
        home = part.column("home_cell").to_numpy()
        maybe &= (home >= cell)[:, None] | ~self.visits[:, home].T  # else found from the other end
        same = (home == cell) & (part.column("home").to_numpy() == block)
        if same.any():  # each pair of a block once, and none with itself
            after = (h1[:, None] > self.h1[None, :]) | ((h1[:, None] == self.h1[None, :]) & (h2[:, None] > self.h2[None, :]))
            maybe &= ~same[:, None] | after
        i, j = np.nonzero(maybe)
        if len(i) > maybe.size // 8:
            ok = (q @ self.x.T)[i, j] >= self.quantiser.least - 1e-12
        else:
            ok = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + 65536]], self.x[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)]) >= self.quantiser.least - 1e-12
        i, j = i[ok], j[ok]
        if not len(i):
            return
        n = np.bincount(i, self.weight[j], len(q)).astype(np.int64)
        self.links += np.bincount(j, weight[i], len(self.links)).astype(np.int64)
        edges: list[tuple[int, int]] = []  # query, member
        starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(i)]):
            roots, first = np.unique(self.label[j[s:e]], return_index=True)
            edges += [(int(i[s]), int(j[s + f])) for f in first.tolist()]
            if len(roots) > 1:
                self.label[np.isin(self.label, roots)] = roots[0]
        a, b = np.array(edges).T
        some = np.flatnonzero(n)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_pydict({"h1": pa.array(h1[some]), "h2": pa.array(h2[some]), "to1": none, "to2": none, "links": pa.array(n[some])})
        yield pa.RecordBatch.from_pydict({"h1": pa.array(h1[a]), "h2": pa.array(h2[a]), "to1": pa.array(self.h1[b]), "to2": pa.array(self.h2[b]), "links": pa.array(np.zeros(len(a), np.int64))})

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.ready and self.links.any():
            k = np.flatnonzero(self.links)
            none = pa.nulls(len(k), pa.int64())
            yield pa.RecordBatch.from_pydict({"h1": pa.array(self.h1[k]), "h2": pa.array(self.h2[k]), "to1": none, "to2": none, "links": pa.array(self.links[k])})
