"""Encoding against the public library, and exact round trips."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import bpe

PATH = f"{bpe.TOKENIZERS}/{bpe.NAME}"
ENCODER = bpe.Encoder(bpe.load_ranks(PATH))
TEXTS = ["", " ", "a", "The quick brown fox, 42!", "  two  blanks\n\n tabs\t\t", "naïve café – „Zitat“", "日本語のテキスト。", "<|endoftext|> is text", "👩‍💻 ok", "x" * 5000, " " * 4000, "ab" * 3000 + "\x00\x01", "it's we'll I'M"]


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(public, text):
    assert ENCODER.encode(text) == public(text)
    assert ENCODER.decode(ENCODER.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    assert ENCODER.decode(ENCODER.encode(text)) == text


def test_merge_equals_the_plain_way():
    """Merge the best pair again and again, by looking at all pairs."""
    ranks, rng = ENCODER.ranks, random.Random(6)
    for _ in range(200):
        piece = bytes(rng.choice(b"aeinrst th") for _ in range(rng.randrange(1, 30)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert bpe.merge(piece, ranks) == [ranks[p] for p in parts]


def test_frames(spark):
    df = spark.createDataFrame([(1, "hello world", "z"), (2, None, "z"), (3, "", "z")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    assert got == {1: ENCODER.encode("hello world"), 2: [], 3: []}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df).collect()} == {1: 2, 2: 0, 3: 0}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()} == {1: "hello world", 2: "", 3: ""}
    assert bpe.encode(df.limit(0)).count() == 0
