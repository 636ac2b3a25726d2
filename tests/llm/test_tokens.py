import os
import random

import pytest

from quorumlake.llm.tokens import PATTERN, Encoder, count_tokens, encode_corpus, load_ranks, merge_bytes, vocabulary_path

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary_path()), reason="no vocabulary file")


@pytest.fixture(scope="module")
def theirs():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(vocabulary_path()), special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return Encoder(vocabulary_path(), remember=50)


def texts():
    rng = random.Random(1)
    alphabet = "abcde ABC אבגדה ושל\n\t .,'0123456789éñ🗳‏"
    out = ["", " ", "  a", "<|endoftext|>", "it's we'll", "א" * 3000, "x" * 20001, "\n\n\n", "á", "🗳" * 50, "1234567 89", " lead", "trail ", "a\u00a0 b", "x \u2003y", "a\nb c\n", "don't we 'll", "a \x1cb"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(300)]


def test_equals_another_implementation(ours, theirs):
    for t in texts():
        assert ours.encode(t) == theirs.encode_ordinary(t), t[:50]


def test_round_trip(ours):
    back = {v: k for k, v in ours.ranks.items()}
    for t in texts():
        assert b"".join(back[i] for i in ours.encode(t)).decode() == t


def test_leftmost_lowest_first():
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"aba": 4, b"abab": 5}
    assert merge_bytes(b"abab", ranks) == [5] and merge_bytes(b"aab", ranks) == [0, 2] and merge_bytes(b"bab", ranks) == [1, 2] and merge_bytes(b"a", ranks) == [0]
    assert merge_bytes(b"ababa", ranks) == [2, 4]


def test_corpus(spark, theirs):
    rows = [(1, "שלום עולם"), (2, None), (3, ""), (4, "a" * 5000), (4, "x")]
    df = spark.createDataFrame(rows, "ids bigint, n string").withColumnRenamed("ids", "doc")
    got = sorted((r["doc"], list(r["ids"])) for r in encode_corpus(df, "doc", "n").collect())
    assert got == sorted((i, theirs.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((r["doc"], r["n_tokens"]) for r in count_tokens(df, "doc", "n").collect()) == sorted((i, len(x)) for i, x in got)
    assert encode_corpus(df.limit(0), "doc", "n").count() == 0
