import random
import re

import numpy as np
import pyarrow as pa

from docloom.llm import text
from docloom.llm.common import bytes_of, slices


def test_words_and_shingles():
    rng = random.Random(4)
    docs = [None, "", " ", "a", "A b", "\n"] + ["".join(rng.choice(["a", "B", "é", " ", "\t", "\n", "xyz", "\x85", "\xa0"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    buf, offs = bytes_of(pa.array(docs).slice(1))
    names = {}
    for lo, hi in slices(offs, 300):
        words, first = text.word_hashes(buf, offs[lo : hi + 1])
        for n in (1, 2, 5):
            sh, at = text.shingles(words, first, n)
            for k in range(lo, hi):
                w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[k + 1]))
                assert first[k - lo + 1] - first[k - lo] == len(w)
                want = [(n, *w[i : i + n]) for i in range(len(w) - n + 1)] or ([(n, *w)] if w else [])
                got = sh[at[k - lo] : at[k - lo + 1]].tolist()
                assert len(got) == len(want)
                for x, y in zip(want, got):
                    assert names.setdefault(x, y) == y
    for n in (1, 2, 5):
        own = [y for x, y in names.items() if x[0] == n]
        assert len(set(own)) == len(own)
