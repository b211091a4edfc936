"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own. A segment tree over its byte positions keeps, for every
span, the leftmost position whose pair with its live right neighbour has the least rank; a merge changes two
pairs and kills one position, so it costs three point updates of logarithmic depth. The ids equal those of the
usual rank-file encoders: a match that is itself a vocabulary entry is that one id.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows give repeated results;
columns other than doc_id and text are ignored."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import cols

#: Entries that a task keeps of texts already encoded; only speed depends on it.
CACHE = 400_000
#: Longer matches are not kept.
CACHE_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match by repeated merging of the leftmost pair of least rank."""
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    bits = max(1, (n - 1).bit_length())
    size, none = 1 << bits, 1 << 62  # none is above every key
    # A key is rank * size + position, so that the least key is the leftmost pair of least rank.
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << bits | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    while (top := tree[1]) != none:
        # Position i takes in its neighbour j; their pairs with the neighbours k and h change.
        i = top & size - 1
        j = nxt[i]
        k = nxt[i] = nxt[j]
        h, stop = prv[i], end[j]
        end[i] = stop
        tree[size + j] = tree[size + i] = none
        if k < n:
            prv[k] = i
            r = get(piece[i : end[k]])
            if r is not None:
                tree[size + i] = r << bits | i
        x = z = size + i >> 1
        y = size + j >> 1
        if h >= 0:
            r = get(piece[h:stop])
            tree[size + h] = none if r is None else r << bits | h
            z = size + h >> 1
        # Up from the three points at once, as their ways soon meet.
        while x:
            a, b = tree[2 * x], tree[2 * x + 1]
            tree[x] = a if a < b else b
            if y != x:
                a, b = tree[2 * y], tree[2 * y + 1]
                tree[y] = a if a < b else b
            if z != x:
                a, b = tree[2 * z], tree[2 * z + 1]
                tree[z] = a if a < b else b
            x, y, z = x >> 1, y >> 1, z >> 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids, and back."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.bytes = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for b, r in self.ranks.items():
            self.bytes[r] = b
        self.known = _Known(self.ranks)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.known) > CACHE:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Known(dict):
    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= CACHE_BYTES:
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker; the vocabulary file is read where the work is done."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless with_ids is false, ids (array of int).

    The ids are decoded again, and decoded_sha256 is taken of the bytes that this gives."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, sums, back, ids = [], [], [], []
                for text in part.column("text"):
                    got = c.encode(text.as_py())
                    n.append(len(got) // 4)
                    sums.append(hashlib.sha256(got).hexdigest())
                    back.append(hashlib.sha256(c.decode(got)).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(got, "<u4").astype(np.int32))
                out = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                if with_ids:
                    out["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    kind = dict(docs.dtypes)["doc_id"]
    return cols(docs, "doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
