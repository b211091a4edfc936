import numpy as np
import pytest

from docloom.llm import pq

SCHEMA = "vec_id long, embedding array<float>, weight int"


def brute(rows, least=0.9):
    x, out, root = [], {}, {}
    for i, v, *_ in rows:
        ok = i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        x.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    n = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if x[a] is not None and x[b] is not None and len(x[a]) == len(x[b]) and x[a] @ x[b] >= least - 1e-12:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    for a, r in enumerate(rows):
        if r[0] is not None:
            out[find(a)] = min(out.get(find(a), r[0]), r[0])
    return sorted(((r[0], n[a], out[find(a)] if r[0] is not None else None) for a, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("block,spread", [(2048, 0.12), (40, 0.2)])
def test_against_brute_force(spark, monkeypatch, block, spread):
    monkeypatch.setattr(pq, "BLOCK", block)
    monkeypatch.setattr(pq, "ROOT", 1)
    monkeypatch.setattr(pq, "TURN", 10 * block)
    rng = np.random.default_rng(block)
    base = rng.normal(0, 1, (30, 16))
    vec = lambda: [float(c) for c in np.float32((base[rng.integers(30)] + rng.normal(0, spread * 2, 16)) * rng.choice([0.5, 1, 7]))]
    rows = [(i, vec(), 1) for i in range(900)]
    rows += [(900 + i, rows[3][1], 1) for i in range(80)] + [(990, None, 1), (991, [], 1), (992, [0.0] * 16, 1), (993, [1.0, None] * 8, 1), (994, [float("inf")] + [1.0] * 15, 1), (None, rows[3][1], 1), (995, [1.0, 2.0], 1), (996, [1.0, 2.1], 1), (997, [1e-30] * 16, 1), (998, [1e30] * 16, 1)]
    got = pq.links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("dim,rank", [(64, 3), (64, 8), (384, 4), (768, 8)])
def test_clusters_of_low_rank_in_many_dimensions(spark, monkeypatch, dim, rank):
    monkeypatch.setattr(pq, "ROOT", 1)
    monkeypatch.setattr(pq, "TURN", 500)
    rng = np.random.default_rng(dim)
    flat = rng.normal(0, 1, (900, rank)) @ np.linalg.qr(rng.normal(0, 1, (dim, rank)))[0].T
    rows = [(i, [float(c) for c in np.float32(v)], 1) for i, v in enumerate(np.concatenate([flat, rng.normal(0, 1, (300, dim))]))]
    got = pq.links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert pq.links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table_products_bound_the_cosine():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 24))
    x[250:] = x[:250] + rng.normal(0, 0.1, (250, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = pq.Quantiser([x], 0.9, (40 * pq.ROOT) ** 2)
    cell, code = q.encode(x)
    assert len(np.unique(cell)) > 10
    for c in np.unique(cell):
        k = cell == c
        linked = x[k] @ x.T >= 0.9
        maybe = q.products(x, int(c), code[k]) >= q.floors(x[k], int(c), code[k])[:, None]
        assert maybe[linked].all()
        assert maybe.mean() < 0.9


def test_a_link_across_cells_is_probed_from_one_end():
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (600, 5)) @ rng.normal(0, 1, (5, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = pq.Quantiser([x], 0.9, (40 * pq.ROOT) ** 2)
    cell, _ = q.encode(x)
    seen = q.probes(x, cell)[:, cell]
    linked = x @ x.T >= 0.9
    assert (seen | seen.T)[linked].all() and not (seen | seen.T).all()
