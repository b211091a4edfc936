import random

import numpy as np
import pytest

from docloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, every, k):
    ok = [(i, np.array([int(np.floor(256 * x)) for x in v], object)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in ok:
        if q % every == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q and len(x) == len(y))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 37])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, (12, 16))
    data = [(i, [float(x) for x in np.float32(base[rng.integers(12)] + rng.normal(0, 0.3, 16))], "s") for i in range(1500)]
    same = data[7][1]
    data += [(1500 + i, same, "s") for i in range(200)] + [(2000, None, ""), (2001, [], ""), (2050, [1.0, None] * 8, ""), (2100, [float("nan")] * 16, ""), (2150, [0.0] * 16, ""), (None, same, ""), (2200, [1.0, 2.0], ""), (2201, [3.0, -4.0], ""), (2250, [1.0] * 5, "")]
    got = topk.top_k(spark.createDataFrame(data, SCHEMA), every=50, k=5).collect()
    assert sorted(map(tuple, got)) == brute(data, 50, 5)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], ""), (1, [0.5, 0.5], ""), (100, [2.0, 0.1], "")], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute([tuple(r) for r in df.collect()], 50, 5)
    assert topk.top_k(df.limit(0)).count() == 0


def test_large_components_stay_exact():
    rng = random.Random(2)
    q = np.array([[rng.randrange(-(2**30), 2**30) for _ in range(4)]], float)
    y = np.array([[rng.randrange(-(2**30), 2**30) for _ in range(4)] for _ in range(3)], float)
    assert topk.products(q, y).tolist() == [[sum(int(a) * int(b) for a, b in zip(q[0], r)) for r in y]]


def test_large_vectors_take_part(spark):
    schema = "vec_id long, embedding array<double>, score string"
    rows = [(0, [1.0, 0.0], ""), (1, [9e6, 0.0], ""), (2, [0.5, 0.0], ""), (50, [-3.0, 2.0], ""), (51, [1e12, 1.0], ""), (52, [-1e13, 0.0], "")]
    got = topk.top_k(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 50, 5)
    assert next(r.vec_id for r in got if r.query_id == 0 and r["rank"] == 1) == 51
    with pytest.raises(Exception, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e300, 0.0], ""), (1, [1.0, 0.0], "")], schema)).collect()


def test_bounds_leave_most_of_clustered_rows_alone(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (60, 32))
    x = base[rng.integers(60, size=6000)] + rng.normal(0, 0.1, (6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index, _ = topk.build(spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], "vec_id long, embedding array<double>, score string"), "vec_id", "embedding", 256.0)
    q, rings = np.floor(256 * x[:200]), index.rings[32]
    floor = np.sort(q @ np.floor(256 * x).T, axis=1)[:, -6]
    bound = index.bounds(q)
    visited = ((bound >= floor[:, None]) * rings[:, 2]).sum() / (200 * 6000)
    assert visited < 0.2
    best = np.floor(256 * x) @ q.T
    pivot, ring, _ = index.place(np.floor(256 * x))
    number = {(int(p), int(r)): k for k, (p, r) in enumerate(rings[:, :2])}
    own = np.array([number[p, r] for p, r in zip(pivot.tolist(), ring.tolist())])
    assert (best <= bound.T[own]).all()
