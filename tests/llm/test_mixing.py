import random
import re
from collections import Counter, defaultdict

from docloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows():
    rng = random.Random(5)
    out = [(i, " ".join(rng.choice(["a", "bb", "cé"]) for _ in range(rng.choice([0, 1, 3, 40, 900]))), "en", rng.choice(["s1"] * 6 + ["s2", "s3", "é", None]), 0, "x") for i in range(300)]
    return out + [(300, None, None, "s2", None, "x"), (301, " \n\t", "en", "empty", 3, "x"), (1, "same row", "en", "s3", 8, "x"), (1, "same row", "en", "s3", 8, "x"), (None, "no id", "en", "s3", 5, "x"), (302, "w " * 40_000, "de", "s1", 80_000, "x")]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    documents, pieces = mixing.mix(df, block=32)
    got = mixing.taken(pieces).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in data)
    sums = defaultdict(int)
    for r in data:
        sums[r[3]] += size(r[1])
    target = brute_targets(sums)
    source = {(r[0], size(r[1])): r[3] for r in data}
    took = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sums[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 2 * r["size"]
        took[s] += r.taken
    for s in sums:
        assert abs(took[s] - target[s]) <= 1, (s, took[s], target[s])
    again = mixing.taken(mixing.mix(df.repartition(7), block=32)[1]).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_every_slot_has_its_own_place_and_shards_follow_the_targets(spark):
    df = spark.createDataFrame([(i, "w " * 64, "en", "ab"[i % 2], 128, "x") for i in range(400)], SCHEMA)
    _, pieces = mixing.mix(df, weights=(3, 1), share=1.0, block=16, shard_blocks=100)
    p = pieces.where("n > 0").collect()
    assert len({(r.shard, r.place) for r in p}) == len(p) == 1600 and {r.place for r in p} == set(range(100))
    count = Counter((r.shard, r.source_no) for r in p)
    assert all(55 <= count[s, 0] <= 92 for s in range(16)) and len({count[s, 0] for s in range(16)}) > 3


def test_texts_hold_what_was_taken(spark):
    df = spark.createDataFrame([r for r in rows() if r[0] != 1], SCHEMA)
    _, pieces = mixing.mix(df, block=32)
    by = {r.doc_id: r.taken for r in mixing.taken(pieces).collect()}
    out = mixing.texts(df, pieces)
    assert out.columns == df.columns
    words = Counter()
    whole = {r[0]: (r[1] or "").split() for r in rows()}
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(whole[r.doc_id])
    assert words == Counter({k: v for k, v in by.items() if v})


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.taken(mixing.mix(df)[1]).count() == 0


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 97, 1000):
        df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(9)).alias("y")).select("id", "y", mixing.permuted(F.col("y"), F.lit(n), F.lit(9), back=True).alias("x"))
        got = df.collect()
        assert sorted(r.y for r in got) == list(range(n)) and all(r.x == r.id for r in got)
