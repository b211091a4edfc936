import random
import zlib

import numpy as np

from docloom.llm import quality

DOCS, LABELS = "doc_id long, text string, lang string, score int", "doc_id long, quality int, toxic int"


def rows():
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(1200):
        words = ["".join(rng.choice(["the", "an", "er", "ou", "ti"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        good = int(rng.random() < 0.7)
        docs.append((i, " ".join(words) if good else " ".join(w + rng.choice(["%%%", "###", "!!"]) for w in words), "en", 0))
        if i % 2:
            labels.append((i, good, 0))
    return docs, labels


def test_held_out_accuracy_and_defined_results(spark):
    docs, labels = rows()
    odd = [(5000, None, "x", 1), (5001, "", None, 1), (None, "the an er", "x", 1), (docs[0][0], docs[0][1], "x", 1), (5002, "the " * 40_000, "x", 1)]
    df = spark.createDataFrame(docs + odd, DOCS)
    lab = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], LABELS)
    got = quality.score(df, lab).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {i: int("%%%" not in t and "###" not in t and "!!" not in t) for i, t, *_ in docs}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[5000] == by[5001] and len({r.score for r in got if r.doc_id == 0}) == 1
    again = quality.score(df.repartition(5), lab.repartition(3)).collect()
    assert max(abs(by[r.doc_id] - r.score) for r in again) < 1e-6


def test_few_or_no_labels(spark):
    docs, _ = rows()
    df = spark.createDataFrame(docs[:20], DOCS)
    assert {r.score for r in quality.score(df, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS)
    assert len({r.score for r in quality.score(df, one).collect()}) == 1
    assert quality.score(df.limit(0), one).count() == 0


def test_tokens_do_not_cross_texts():
    import pyarrow as pa

    from docloom.llm.common import bytes_of

    b, first = quality.tokens(*bytes_of(pa.array(["ab", "cd!!", "", " ab  cd!!", "abcd"])))
    parts = [b[x:y].tolist() for x, y in zip(first, first[1:])]
    assert parts[3] == parts[0] + parts[1] and parts[2] == [] and len(parts[4]) == 1
