"""Most frequent items among billions, in bounded memory: a hierarchical count-sketch.

An item is known by 64 hash bits. For each prefix length of those bits a count-sketch (``rows`` hash rows of ``width``
signed counters) is kept; the sketches of all tasks add up. From the heavy prefixes of one length the search descends to
the next: only children of a prefix whose estimate can still reach the threshold are looked at. The hashes left at
full length are the candidates; a second scan counts exactly the items with such a hash.

Memory: ``levels * rows * width`` counters a task and on the driver, whatever the number of items. The sketches of the tasks
are added up in pieces of 1024 counters, first 64 ways, then to one, each sum taking one piece at a time, so no worker ever
holds more than a batch of pieces, however many tasks there are. The error of an
estimate is about ``sqrt(F2 / width)`` (median of the rows), F2 being the sum of squared counts without the items so
heavy that they are alone in most of their counters. Items below the threshold share have ``F2 <= share * n**2``, so a
width of ``36 / share`` keeps three deviations within half the threshold; the descent follows every prefix whose
estimate reaches ``slack`` times the threshold less that error, and the second scan makes the counts exact.

Defined results: null items are not counted and not part of the total; an empty table gives no rows; the empty string
is an item; ties are all returned; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prefix lengths in bits, from the root down; a step is eight bits, so a heavy prefix has 256 children to look at.
LEVELS = (8, 16, 24, 32, 40, 48, 56, 64)
ROWS = 5
#: Counters of a piece of a sketch, and sums a piece goes through on its way to one.
PIECE, WAYS = 1024, 64


def width_for(share: float) -> int:
    """Counters a hash row needs for a threshold share: the power of two from 36 / share."""
    return 1 << max(10, math.ceil(math.log2(36 / share)))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def cells(prefix: np.ndarray, level: int, row: int, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each prefix in one hash row of one level; seed: another family of hash functions."""
    h = _mix(prefix, 64 * level + row + 8192 * seed)
    return (h % np.uint64(width)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1).astype(np.int64)


def sketch(items: np.ndarray, counts: np.ndarray, levels: tuple[int, ...], rows: int, width: int, seed: int = 0) -> np.ndarray:
    """The counters (level, row, counter) of items with their counts."""
    out = np.zeros((len(levels), rows, width), np.int64)
    for i, bits in enumerate(levels):
        prefix, at = np.unique(items >> np.uint64(64 - bits), return_inverse=True)
        n = np.bincount(at, weights=counts).astype(np.int64)
        for j in range(rows):
            c, s = cells(prefix, bits, j, width, seed)
            out[i, j] = np.bincount(c, weights=s * n, minlength=width).astype(np.int64)
    return out


def estimate(table: np.ndarray, prefix: np.ndarray, bits: int, seed: int = 0) -> np.ndarray:
    """Estimated counts of prefixes at one level: the median over the hash rows."""
    got = []
    for j in range(table.shape[0]):
        c, s = cells(prefix, bits, j, table.shape[1], seed)
        got.append(s * table[j, c])
    return np.median(np.array(got), axis=0)


def descend(sk: np.ndarray, threshold: float, levels: tuple[int, ...], slack: float, seed: int = 0) -> np.ndarray:
    """Full-length hashes whose every prefix may reach the threshold."""
    prefix = np.arange(1 << levels[0], dtype=np.uint64)
    before = levels[0]
    for i, bits in enumerate(levels):
        step = bits - before
        if step:
            prefix = ((prefix[:, None] << np.uint64(step)) | np.arange(1 << step, dtype=np.uint64)[None, :]).ravel()
        # the usual size of a counter (robust against the heavy ones) is the noise of an estimate
        noise = 1.4826 * np.median(np.abs(sk[i]))
        prefix = prefix[estimate(sk[i], prefix, bits, seed) >= max(threshold / 2, slack * threshold - 3 * noise)]
        before = bits
    return prefix


def _sketch_partition(levels: tuple[int, ...], rows: int, width: int):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((len(levels), rows, width), np.int64), 0
        held: list[np.ndarray] = []
        size = 0

        def fold() -> None:
            nonlocal held, size, total
            if held:
                items, counts = np.unique(np.concatenate(held), return_counts=True)
                total += sketch(items, counts, levels, rows, width)
                held, size = [], 0

        for pdf in batches:
            h = pdf["h"].to_numpy(np.int64).view(np.uint64)
            n += len(h)
            held.append(h)
            size += len(h)
            if size >= 1 << 18:
                fold()
        fold()
        if n:
            pieces = [_packed(x) for x in total.reshape(-1, PIECE)]
            yield pd.DataFrame({"piece": range(len(pieces)), "n": [n] + [0] * (len(pieces) - 1), "counters": pieces})
    return go


_PIECES = "piece int, n long, counters binary"


def _packed(x: np.ndarray) -> bytes:
    """A piece's counters in the fewest bytes that hold them all."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, {2: np.int16, 4: np.int32, 8: np.int64}[len(b) // PIECE])


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the pieces of a partition sorted by piece, one sum held at a time."""
    now, n, total, out = None, 0, np.zeros(PIECE, np.int64), []
    for pdf in batches:
        for piece, k, b in zip(pdf["piece"], pdf["n"], pdf["counters"]):
            if piece != now and now is not None:
                out.append((now, n, _packed(total)))
                n, total = 0, np.zeros(PIECE, np.int64)
            now, n = piece, n + int(k)
            total += _unpacked(b)
        if len(out) >= 256:
            yield pd.DataFrame(out, columns=["piece", "n", "counters"])
            out = []
    if now is not None:
        yield pd.DataFrame([*out, (now, n, _packed(total))], columns=["piece", "n", "counters"])


def build(df: DataFrame, item: str, levels: tuple[int, ...] = LEVELS, rows: int = ROWS, width: int = 8192) -> tuple[int, np.ndarray]:
    """The sketch of a column and its number of non-null rows."""
    hashed = df.where(F.col(item).isNotNull()).select(F.xxhash64(F.col(item)).alias("h"))
    parts = hashed.mapInPandas(_sketch_partition(levels, rows, width), _PIECES).withColumn("way", F.spark_partition_id() % WAYS)
    some = parts.repartition("piece", "way").drop("way").sortWithinPartitions("piece").mapInPandas(_add, _PIECES)
    whole = some.repartition("piece").sortWithinPartitions("piece").mapInPandas(_add, _PIECES)
    n, total = 0, np.zeros((len(levels) * rows * width // PIECE, PIECE), np.int64)
    for r in whole.toLocalIterator():  # one sketch of fixed size
        n += r["n"]
        total[r["piece"]] = _unpacked(r["counters"])
    return n, total.reshape(len(levels), rows, width)


def heavy_hitters(
    df: DataFrame, item: str, share: float, levels: tuple[int, ...] = LEVELS, rows: int = ROWS, width: int | None = None, slack: float = 0.8,
) -> DataFrame:
    """Items in at least ``share`` of the non-null rows: ``item, estimate, n, total`` (estimate by the sketch, n exact).

    The candidate list is about ``2 / share`` long at most.
    """
    spark = df.sparkSession
    width = width or width_for(share)
    n, sk = build(df, item, levels, rows, width)
    kind = df.schema[item].dataType.simpleString()
    found = descend(sk, max(1.0, share * n), levels, slack) if n else np.zeros(0, np.uint64)
    est = estimate(sk[-1], found, levels[-1]) if len(found) else []
    rows_ = [(int(h), float(e)) for h, e in zip(found.view(np.int64), est)]
    if not rows_:
        return spark.createDataFrame([], f"item {kind}, estimate double, n long, total long")
    at = spark.createDataFrame(rows_, "h long, estimate double")  # bounded by the threshold, not by the data
    second = df.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.xxhash64(F.col(item)).alias("h"))
    counted = second.join(F.broadcast(at), "h").groupBy("item").agg(F.first("estimate").alias("estimate"), F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= share * n * (1 - 1e-12)).withColumn("total", F.lit(n).cast("long"))
