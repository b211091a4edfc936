import random
import re

import pytest

from docloom.llm.components import components
from docloom.llm.neardup import near_duplicates


def brute(rows, n, percent=80):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and rows[i][0] is not None and rows[j][0] is not None and 100 * same >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if r[0] is not None else None) for i, r in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []

    def add(text):
        rows.append((len(rows) + 10, text, "digest"))

    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 6, 12, 50, 200]))]
        now = base
        for _ in range(rng.choice([1, 1, 2, 6])):
            now = list(now if rng.random() < 0.5 else base)
            for _ in range(max(1, len(now) // 40)):
                if rng.random() < 0.7:
                    now[rng.randrange(len(now))] = rng.choice(words)
            add(rng.choice([" ", "\n"]).join(now if rng.random() < 0.8 else [w.upper() for w in now]))
    shared = " ".join(rng.choice(words) for _ in range(60))
    for _ in range(60):
        add(shared + " " + " ".join(rng.choice(words) for _ in range(rng.randint(10, 60))))
    for _ in range(30):
        add("the very same text in every one of these")
    add("")
    add(None)
    add(" \n ")
    rows.append((None, "the very same text in every one of these", "x"))
    rows.append((10_000, "x " * 30_000, "x"))
    rows.append((10_000, "x " * 30_000, "x"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [2, 5])
def test_against_brute_force(spark, n):
    rows = corpus(n)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, digest string"), n).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, n)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_small_regions_and_windows(spark, monkeypatch):
    from docloom.llm import neardup

    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(99)}" for w in base), "") for i in range(150)]
    monkeypatch.setattr(neardup, "REGION", 16)
    monkeypatch.setattr(neardup, "ROOM", 16 * 400)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, digest string"), 2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 2)


def planted(rng, shared, own, changed, pairs):
    """Pairs of near copies in a template that all texts share, in any order."""
    template, rows = [f"t{i}" for i in range(shared)], []
    for _ in range(pairs):
        a = [f"x{rng.randrange(10**9)}" for _ in range(own)]
        b = a[: own - changed] + [f"y{rng.randrange(10**9)}" for _ in range(changed)]
        rows += [template + a, template + b]
    rng.shuffle(rows)
    return [(i, " ".join(x), "") for i, x in enumerate(rows)]


def whole(spark, monkeypatch, rows, region):
    from docloom.llm import neardup

    want = brute(rows, 1)
    assert len({x[2] for x in want}) == len(rows) // 2
    monkeypatch.setattr(neardup, "REGION", region)
    monkeypatch.setattr(neardup, "ROOM", region * 400)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, digest string"), 1).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_pairs_in_a_template_that_exhausts_all_minima(spark, monkeypatch):
    whole(spark, monkeypatch, planted(random.Random(3), 176, 24, 22, 100), 4)


def test_pairs_that_share_few_minima_with_many_others(spark, monkeypatch):
    whole(spark, monkeypatch, planted(random.Random(4), 140, 60, 22, 100), 4)


def test_crowded_prefixes_and_partitions(spark, monkeypatch):
    """Classes that all share minima, some in one large component: the same result for any number of partitions."""
    from docloom.llm import neardup

    rng = random.Random(6)
    template = [f"t{i}" for i in range(100)]
    texts = [" ".join(template + [f"x{rng.randrange(10**9)}" for _ in range(60)]) for _ in range(80)]
    base = template + [f"z{i}" for i in range(60)]
    texts += [" ".join(w if rng.random() > 0.03 else f"y{rng.randrange(99)}" for w in base) for _ in range(120)]
    rows = [(i, x, "") for i, x in enumerate(texts)]
    rng.shuffle(rows)
    want = brute(rows, 2)
    monkeypatch.setattr(neardup, "REGION", 8)
    monkeypatch.setattr(neardup, "ROOM", 8 * 400)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, digest string"), 2).collect()
            assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("small", [1 << 20, 10])
def test_components(spark, monkeypatch, small):
    from docloom.llm import components as module

    monkeypatch.setattr(module, "SMALL", small)
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 200)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in root if any(find(x) == find(y) and x != y for y in root))
    got = sorted(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == want
