import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from docloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_equal_the_library(reference):
    c, rng = bpe.codec(PATH, P.PATTERN), random.Random(1)
    alphabet = "aabcdethe nrs  \n\t'0123éèßñ你好🙂\x00\x1c\x85 .,!|%"
    for n in [0, 1, 2, 3, 5, 17, 100, 3000]:
        for _ in range(30 if n < 1000 else 2):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            ids = list(memoryview(c.encode(text)).cast("I"))
            assert ids == reference.encode_ordinary(text)
            assert c.decode(c.encode(text)) == text.encode()


def test_one_long_run_of_letters(reference):
    text = "thein" * 8000
    assert list(memoryview(bpe.codec(PATH, P.PATTERN).encode(text)).cast("I")) == reference.encode_ordinary(text)


def test_rows(spark, reference):
    rows = [(1, "Hello there", "x"), (2, None, "x"), (3, "", "x"), (None, "a b", "x"), (1, "Hello there", "x"), (4, "a" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode(df, PATH, P.PATTERN).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[2].n_tokens == by[3].n_tokens == 0 and by[2].ids == [] and by[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[4].ids == reference.encode_ordinary("a" * 50_000)
    assert by[None].decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
