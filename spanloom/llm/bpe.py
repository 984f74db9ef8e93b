"""Encoding of a corpus with a public byte-level tokenizer.

Text is split by the tokenizer's pattern; each piece's bytes become a doubly linked list of symbols, and adjacent pairs
wait in a priority queue by merge rank. The best pair is merged, its neighbours' pairs are queued, and entries whose
symbols have changed since are stale and skipped, so a piece of n bytes takes O(n log n) steps, however long its runs.
Decoding concatenates the vocabulary's byte strings.

The rank file is read once on the driver (its size is fixed: about 50,000 entries) and sent to the tasks; a task keeps
the ids of short pieces it has met, up to ``CACHE`` of them.

Defined results: null and empty texts give an empty list; no special tokens are added, and their strings within a text
are ordinary text; ``n_tokens`` of a null text is 0; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie, and the one used.
TOKENIZERS, NAME = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept per task, and the longest that is kept.
CACHE, CACHE_BYTES = 200_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    sym: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            queue.append((r, i, piece[i : i + 2]))
    heapq.heapify(queue)
    while queue:
        _, i, pair = heapq.heappop(queue)
        a = sym[i]
        j = nxt[i]
        if a is None or j >= n or a + sym[j] != pair or len(a) == len(pair):  # type: ignore[operator]
            continue  # stale: one of the two was merged since
        sym[i], sym[j] = pair, None
        k = nxt[j]
        nxt[i] = k
        if k < n:
            prv[k] = i
            both = pair + sym[k]  # type: ignore[operator]
            r = ranks.get(both)
            if r is not None:
                heapq.heappush(queue, (r, i, both))
        h = prv[i]
        if h >= 0:
            both = sym[h] + pair  # type: ignore[operator]
            r = ranks.get(both)
            if r is not None:
                heapq.heappush(queue, (r, h, both))
    out, i = [], 0
    while i < n:
        out.append(ranks[sym[i]])  # type: ignore[index]
        i = nxt[i]
    return out


class Encoder:
    """Encodes and decodes texts; remembers short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.known: dict[str, list[int]] = {}
        self.back: dict[int, bytes] | None = None

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for m in self.split.finditer(text):
            piece = m.group()
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                ids = merge(raw, self.ranks)
                if len(raw) <= CACHE_BYTES:
                    if len(known) >= CACHE:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        if self.back is None:
            self.back = {i: b for b, i in self.ranks.items()}
        return b"".join(self.back[i] for i in ids).decode("utf-8", "replace")


def _encoder(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())  # under 1 MB, whatever the corpus
    held: list[Encoder] = []

    def get() -> Encoder:
        if not held:
            held.append(Encoder(parse_ranks(data.value)))
        return held[0]
    return get


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", path: str = f"{TOKENIZERS}/{NAME}") -> DataFrame:
    """``key, ids`` of every row."""
    get = _encoder(df.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = get()
        for s in batches:
            yield pd.Series([e.encode(x) for x in s.where(s.notna(), None)], index=s.index, dtype=object)

    return df.select(F.col(key), ids(F.col(text)).alias("ids"))


def token_counts(df: DataFrame, text: str = "text", path: str = f"{TOKENIZERS}/{NAME}", name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of its text; ids never leave the task."""
    get = _encoder(df.sparkSession, path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = get()
        for s in batches:
            yield pd.Series([len(e.encode(x)) for x in s.where(s.notna(), None)], index=s.index, dtype="int64")

    return df.withColumn(name, count(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", path: str = f"{TOKENIZERS}/{NAME}", name: str = "text") -> DataFrame:
    """``df`` with the text its ids stand for; null ids give null."""
    get = _encoder(df.sparkSession, path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = get()
        for s in batches:
            yield s.map(lambda x: None if x is None else e.decode([int(i) for i in x]))

    return df.withColumn(name, text(F.col(ids)))
