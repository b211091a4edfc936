"""Words and word shingles of many texts at once, as 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Each byte has a random 64-bit value;
a word's hash is a polynomial in these, taken from running sums over the whole buffer, so that no loop runs over words."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(20240817)
#: A random value for each byte; A-Z have those of a-z.
_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_VALUE[65:91] = _VALUE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        held = np.multiply.accumulate(x)
        if n <= 1 << 22:  # a longer text has its own
            _POWERS[base] = held
    return held[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts buf[offs[i]:offs[i + 1]], relative to offs[0], and the n + 1 places in them where texts begin."""
    own = buf[offs[0] : offs[-1]]
    cut = (offs - offs[0]).astype(np.int64)
    word = ~SPACE[own]
    edge = np.zeros(len(own) + 1, bool)
    edge[cut] = True
    before = np.concatenate([[False], word])
    after = np.concatenate([word, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, cut)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word, and the n + 1 places where texts begin."""
    starts, ends, first = spans(buf, offs)
    own = buf[offs[0] : offs[-1]]
    sums = np.concatenate([[_U(0)], np.cumsum(_VALUE[own] * _powers(_P, len(own)), dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * _powers(_P_INV, len(own) + 1)[starts]), first


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n words in a row, repeats included, and the places where texts begin; a text of fewer words, but some, gives one of all its words."""
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    if len(words) >= n:
        h = words[: len(words) - n + 1].copy()
        for j in range(1, n):
            h = mixed(h * _U(0xD6E8FEB86659FD93) + words[j : len(words) - n + 1 + j])
    else:
        h = np.zeros(0, np.uint64)
    out = np.zeros(at[-1], np.uint64)
    doc = np.repeat(np.arange(len(count)), made)
    where = first[doc] + np.arange(at[-1]) - at[doc]
    full = count[doc] >= n
    out[full] = h[where[full]]
    for i in np.flatnonzero((count > 0) & (count < n)):
        x = words[first[i] : first[i] + 1]
        for j in range(first[i] + 1, first[i + 1]):
            x = mixed(x * _U(0xD6E8FEB86659FD93) + words[j : j + 1])
        out[at[i]] = mixed(x + _U(int(count[i])))[0]  # no shingle of n words is one of fewer
    return out, at
