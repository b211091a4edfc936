"""What the vector operators share: reading arrays from Arrow, and centres fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that centres are fitted on, at most: those with the least hash of their id.
SAMPLE = 20_000


def rows_of(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector that occurs; only rows that are whole and finite."""
    lengths = np.asarray(col.value_lengths().fill_null(0))
    flat = col.flatten()
    bad = np.asarray(flat.is_null()) if flat.null_count else None
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if bad is not None:
        values[bad] = np.nan
    at = np.concatenate([[0], np.cumsum(lengths)])
    for n in np.unique(lengths[lengths > 0]).tolist():
        k = np.flatnonzero(lengths == n)
        m = values[at[k][:, None] + np.arange(n)]
        ok = np.isfinite(m).all(axis=1)
        if ok.any():
            yield k[ok], m[ok]


def binary(m: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(m)], pa.binary())


def matrix(col: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Rows of equal length from a column that binary() made."""
    return np.array([np.frombuffer(x.as_buffer(), dtype) for x in col])


def sample(df: DataFrame, id_col: str, vector: str, most: int = SAMPLE) -> list[np.ndarray]:
    """Matrices of double, one for each length, of at most `most` rows in all."""
    got = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.xxhash64(id_col).alias("h"), id_col, vector).orderBy("h", id_col, vector).limit(most)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m in rows_of(batch.column(vector)):
                yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(m), m.shape[1])), "m": binary(m)})

    by: dict[int, list[np.ndarray]] = {}
    for r in got.mapInArrow(work, "n bigint, m binary").collect():
        by.setdefault(r.n, []).append(np.frombuffer(r.m))
    return [np.array(sorted(v, key=bytes)) for _, v in sorted(by.items())]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its squared distance."""
    out, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    half = (centres * centres).sum(axis=1) / 2
    for lo in range(0, len(x), 4096):
        part = x[lo : lo + 4096]
        k = np.argmin(half - part @ centres.T, axis=1)
        out[lo : lo + 4096] = k
        far[lo : lo + 4096] = ((part - centres[k]) ** 2).sum(axis=1)
    return out, far


def centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means of at most k centres, begun from far-apart rows."""
    rng = np.random.default_rng(seed)
    first = [x[rng.integers(len(x))]]
    gap = ((x - first[0]) ** 2).sum(axis=1)
    while len(first) < k and gap.max() > 1e-12:
        first.append(x[rng.choice(len(x), p=gap / gap.sum())])
        gap = np.minimum(gap, ((x - first[-1]) ** 2).sum(axis=1))
    c = np.array(first)
    for _ in range(rounds):
        own, _ = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], c)
    return c
