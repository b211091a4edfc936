"""Quality scores from random-indexing word vectors and a small calibrated network.

Every token (a run of letters and digits, or a run of signs) falls into one of BUCKETS, which words share, the more the
larger the vocabulary is, and each bucket has a sparse random index vector. A bucket's word vector is the sum of the index vectors of its tokens' neighbours over the whole
corpus, gathered as integer sums on the executors, so that it does not depend on how the input is partitioned.
A document is the mean of its tokens' word vectors and their mean likeness to the next one. A two-layer network gives a probability, whose temperature is
set on labelled rows that were kept out of its training.

Only labels of rows whose crc32(doc_id as text) mod 5 is not 0 are used, at most SAMPLE of them, those with the least
hash of doc_id. Neither labels nor doc_id, lang or source enter a score.

Defined results: a null or empty text is a document without tokens and gets the score of the mean vector zero;
without usable labels every score is 0.5, with labels of one kind only it is their share with one of the other kind
added; null labels are ignored; repeated rows get equal scores; a null doc_id counts as held out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, cols, slices, stored
from .text import _P, _P_INV, _powers, mixed

#: Labelled rows that are learnt from, at most.
SAMPLE = 20_000
BUCKETS, DIM, WINDOW, ONES = 1 << 14, 32, 2, 4
_RNG = np.random.default_rng(11)
_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0, 9, 10, 11, 12, 13, 32]] = 0
_CLASS[128:] = 1
for _r in (range(48, 58), range(65, 91), range(97, 123)):
    _CLASS[list(_r)] = 1
_INDEX = np.zeros((BUCKETS, DIM), np.int8)
_INDEX[np.arange(BUCKETS)[:, None], np.argsort(_RNG.random((BUCKETS, DIM)), axis=1)[:, :ONES]] = _RNG.choice(np.array([-1, 1], np.int8), (BUCKETS, ONES))


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every token, and the n + 1 places where texts begin."""
    own = buf[offs[0] : offs[-1]]
    cut = (offs - offs[0]).astype(np.int64)
    kind = _CLASS[own]
    new = np.ones(len(own) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[cut] = True
    edge = np.flatnonzero(new)
    starts, ends = edge[:-1], edge[1:]
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[own] * _powers(_P, len(own)), dtype=np.uint64)])
    h = mixed((sums[ends] - sums[starts]) * _powers(_P_INV, len(own) + 1)[starts])
    return (h >> np.uint64(50)).astype(np.int64), np.searchsorted(starts, cut)


def contexts(docs: DataFrame) -> np.ndarray:
    """The sums of neighbours' index vectors for each bucket, over all documents."""
    block = 256

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIM), np.int64)
        for batch in batches:
            buf, offs = bytes_of(batch.column("text"))
            for lo, hi in slices(offs, 1 << 19):
                b, first = tokens(buf, offs[lo : hi + 1])
                if not len(b):
                    continue
                doc = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(first))
                vec = _INDEX[b]
                near = np.zeros(vec.shape, np.int8)
                for k in range(1, WINDOW + 1):
                    same = (doc[k:] == doc[:-k])[:, None]
                    near[k:] += vec[:-k] * same
                    near[:-k] += vec[k:] * same
                for d in range(DIM):
                    total[:, d] += np.bincount(b, near[:, d], BUCKETS).astype(np.int64)
        some = np.flatnonzero(total.reshape(-1, block * DIM).any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_pydict({"block": pa.array(some.astype(np.int32)), "sums": pa.array([total[k * block : (k + 1) * block].tobytes() for k in some.tolist()], pa.binary())})

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("block").to_pylist(), batch.column("sums")):
                v = np.frombuffer(x.as_buffer(), np.int64)
                sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "sums": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    parts = cols(docs, "text").mapInArrow(gather, "block int, sums binary").withColumn("part", F.spark_partition_id() % 1024)
    # Two steps: sums of many tasks meet in many tasks first, and only their sums in one for each block.
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(spread, "block", "part").select("block", "sums").mapInArrow(add, "block int, sums binary")
    out = np.zeros((BUCKETS, DIM), np.int64)
    # At most BUCKETS x DIM sums come to the driver, whatever the corpus.
    for row in parts.repartition(BUCKETS // block, "block").mapInArrow(add, "block int, sums binary").collect():
        out[row.block * block : (row.block + 1) * block] += np.frombuffer(row.sums, np.int64).reshape(-1, DIM)
    return out


def vectors(sums: np.ndarray) -> np.ndarray:
    """Word vectors of length 1, with a part of the bucket's own index vector."""
    v = sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))
    v += 0.5 * _INDEX / np.sqrt(ONES)
    return v.astype(np.float32)


def pool(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each text the mean word vector, and the mean likeness (dot product) of each token to the next."""
    dim = table.shape[1]
    out = np.zeros((len(offs) - 1, dim + 1), np.float64)
    for lo, hi in slices(offs, 1 << 19):
        b, first = tokens(buf, offs[lo : hi + 1])
        some = np.flatnonzero(np.diff(first) > 0)
        if len(some):
            v = table[b]
            like = np.zeros(len(b), np.float32)
            like[:-1] = np.einsum("ij,ij->i", v[:-1], v[1:])
            like[first[1:][some] - 1] = 0  # the last token of a text has no next
            n = np.diff(first)[some]
            out[lo + some, :dim] = np.add.reduceat(v, first[some], axis=0).astype(np.float64) / n[:, None]
            out[lo + some, dim] = np.add.reduceat(like, first[some]).astype(np.float64) / np.maximum(1, n - 1)
    return out


class Network:
    """Inputs made uniform, one hidden layer, a logistic output divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3) -> None:
        self.constant = None
        if not len(y):
            self.constant = 0.5
        elif y.min() == y.max():
            self.constant = float((y.sum() + 1 - y[0]) / (len(y) + 1))
        if self.constant is not None:
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            mixed_up = rng.permutation(used)
            for lo in range(0, len(used), 256):
                k = mixed_up[lo : lo + 256]
                h = np.tanh(z[k] @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-(h @ self.w[2] + self.w[3])))
                e = (p - y[k]) / len(k)
                back = np.outer(e, self.w[2]) * (1 - h * h)
                grads = [z[k].T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ e + 1e-4 * self.w[2], np.array([e.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        raw = self._raw(x[held if len(held) else used])
        truth = y[held if len(held) else used]
        heats = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.mean(np.logaddexp(0, -raw / h) * truth + np.logaddexp(0, raw / h) * (1 - truth)) for h in heats]
        self.heat = float(heats[int(np.argmin(loss))])

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._raw(x) / self.heat, -500, 500)))


def _pooled(table: np.ndarray):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(*bytes_of(batch.column("text")), table)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return work


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    table = vectors(contexts(docs))
    known = cols(labels, "doc_id", "quality").where("quality is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality")), "label-sample")
    # The sample has a fixed bound, so it may be broadcast.
    texts = cols(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "text")
    rows = texts.mapInArrow(_pooled(table), "doc_id bigint, quality bigint, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.x)))
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(len(rows), DIM + 1)
    return table, Network(x, np.array([float(r.quality) for r in rows]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; with keep, its own columns in a struct d as well."""
    table, network = fit(docs, labels, sample)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, text = (batch.column("d"), pc.struct_field(batch.column("d"), "text")) if keep else (batch.column("doc_id"), batch.column("text"))
            p = network.scores(pool(*bytes_of(text), table))
            yield pa.RecordBatch.from_pydict({"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32)), "d" if keep else "doc_id": column})

    # With keep a row goes to Python once, as a struct, so that no name of a column can clash.
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("d")) if keep else cols(docs, "doc_id", "text")
    out = rows.mapInArrow(work, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), rows.schema[0]]))
    if keep:
        out = out.withColumn("doc_id", F.col("d.doc_id"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", *["d"] * keep)
