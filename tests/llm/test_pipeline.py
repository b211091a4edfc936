"""The pipeline's stages on a small corpus, each against brute force on its own input."""

import random
import re
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from test_linededup import brute as brute_lines
from test_neardup import brute as brute_pairs

import corpus_pipeline as C
from docloom.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    syllables = ["the", "an", "er", "ou", "ti", "on", "sh"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(400):
        words, good = [word() for _ in range(rng.randint(30, 200))], rng.random() < 0.8
        if i % 9 == 0 and rows:
            words, good = rows[rng.randrange(len(rows))][1].split(), True
            if "%%%" not in " ".join(words):
                words[rng.randrange(len(words))] = word()
        text = " ".join(words if good else [w + "%%%" for w in words])
        text = "\n".join([text, "All rights are reserved by the owner of this site."] if i % 4 == 0 else [text])
        rows.append((i, text, "en", f"s{i % 7}", len(text)))
        if i % 2:
            labels.append((i, int("%%%" not in text), 0))
    rows += [(1000, None, "en", "s1", None), (1001, "", None, None, 0), (1002, rows[5][1], "en", "s2", rows[5][4]), (1002, rows[5][1], "en", "s2", rows[5][4])]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(C.STAGES)
    assert list(stage) == ["quality", "line_dedup", "near_duplicates", "mixing", "tokens"]

    kept = stage["quality"](spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in docs.collect() if "%%%" in (r.text or "")}
    good = {r.doc_id for r in docs.collect() if r.text} - bad
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & bad) <= 0.05 * len(bad) and len(good - ids) <= 0.02 * len(good)

    lines = stage["line_dedup"](spark, kept, sf_dir).cache()
    rows = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    want = [(d, t) for (d, t), r in zip(brute_lines(rows, 5), rows) if not (t is not None and not t.strip() and t != r[1])]
    assert lines.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=str) == sorted(want, key=str)

    single = stage["near_duplicates"](spark, lines, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({d for d, _, root in brute_pairs(rows, 5) if d == root})

    mixed = stage["mixing"](spark, single, sf_dir).cache()
    assert mixed.columns == docs.columns
    size = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect())
    assert abs(size(mixed) - 1.5 * size(single)) <= 7
    most = Counter()
    for r in mixed.collect():
        most[r.doc_id] += 1
    assert max(most.values()) <= 2

    ids = stage["tokens"](spark, mixed, sf_dir)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == Counter((r.doc_id, tuple(enc.encode_ordinary(r.text))) for r in mixed.collect())


def test_run(spark, sf_dir):
    out = C.run(spark, sf_dir)
    assert out.count() > 300 and "ids" in out.columns


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_missing_ids_and_clashing_names(spark, tmp_path):
    """Extra columns named like the stages' own; null ids; one id with two texts; nothing but copies goes."""
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    a, b, c, d = text(), text(), text(), text()
    rows = [(7, a), (7, b), (8, a), (9, c), (9, c), (None, d), (None, d), (None, c), (10, None), (11, ""), (12, b + " more")]
    extra = "lines struct<n_removed: int>, tie string, size int, label string, text2 string, lines_ string, score double, d string, `odd name.x` int"
    docs = spark.createDataFrame([(i, t, "en", None, None, (1,), "t", 3, "l", None, "x", 0.5, "d", 4) for i, t in rows], SCHEMA + ", " + extra)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(C.STAGES)

    kept = stage["quality"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and Counter(map(str, kept.collect())) == Counter(map(str, docs.collect()))
    lines = stage["line_dedup"](spark, kept, str(tmp_path))
    assert lines.columns == docs.columns and Counter((r.doc_id, r.text) for r in lines.collect()) == Counter(rows)

    single = stage["near_duplicates"](spark, lines, str(tmp_path)).cache()
    assert single.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in single.collect())
    # a: 8 is the only document of its id; b: 12 too; c: a row of 9 or the one without id; d: one row.
    assert got[8, a] == 1 and got[12, b + " more"] == 1 and got[None, d] == 1 and got[9, c] + got[None, c] == 1
    assert got[10, None] == 1 and got[11, ""] == 1 and sum(got.values()) == 6

    mixed = stage["mixing"](spark, single, str(tmp_path))
    assert mixed.columns == docs.columns
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(words(mixed) - 1.5 * words(single)) <= 1
    assert stage["tokens"](spark, mixed, str(tmp_path)).count() == mixed.count()
