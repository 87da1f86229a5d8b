import random
from pathlib import Path

import pytest

from loomgraph.llm import encoder as e

pytestmark = pytest.mark.skipif(not Path(e.VOCABULARY).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def enc():
    return e.encoder(e.VOCABULARY)


def test_against_library(enc):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=e.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    r = random.Random(1)
    texts = ["", " ", "\n\n  x", "it's we'll", "<|endoftext|>", "é日本🚀\u200b\u00a0x", "a" * 5000, "ab" * 3000, "0123456789" * 50, "\t\tif x:\r\n"]
    texts += ["".join(r.choice("aabcdeé ñ日 \n\"_12'st<|>") for _ in range(r.randint(0, 300))) for _ in range(300)]
    for t in texts:
        ids = enc.encode(t)
        assert ids == lib.encode_ordinary(t) and enc.decode(ids) == t


def test_two_ways_agree(enc):
    r = random.Random(2)
    for _ in range(200):
        w = "".join(r.choice("aabcdeinstor") for _ in range(r.randint(1, 300))).encode()
        assert e.merge_short(w, enc.ranks) == e.merge_long(w, enc.ranks)


def test_table(spark, enc):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "hello world", "x"), (4, "hello world", "x"), (None, "a", "x"), (5, "long text " * 60_000, "x")]
    got = e.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == sorted(((i, enc.encode(t)) for i, t, _ in rows), key=repr)
    assert e.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
