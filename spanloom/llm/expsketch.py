"""Distinct counts over huge identifier sets: registers of minimum exponential hash values.

Every identifier gives each of ``M`` registers an exponential variable made from its hash; a register keeps the
smallest value it has met. Registers of parts are merged by elementwise minimum, repeated identifiers change nothing, and
the sum of the registers of n identifiers is gamma-distributed with shape M and rate n, so ``(M - 1) / sum`` is an unbiased
count with relative standard error ``1 / sqrt(M - 2)`` (3.1 % for M = 1024) and gamma quantiles give its confidence
interval. An identifier's values are made in ascending order (exponential spacings, placed by a permutation drawn from
the hash), so an identifier stops as soon as it can lower no register: n identifiers cost about ``n + M ln M`` steps
instead of ``n * M``.

A part with at most ``SPARSE`` identifiers keeps their hashes instead of registers: the registers follow from the hashes, so
nothing is lost, and up to that number the hashes are the smaller form of the two. Merging two parts unites the hashes and
turns them into registers when they grow beyond it. The count of a part that still has its hashes is their number, exact up to
64-bit collisions, and its interval is the count itself.

Rows go to tasks by day. A day of many rows is spread over as many tasks as it needs by one of the group columns
(``spread``), and a heavy value of that column by the identifier. A cell that lies in one task as a whole (its day was not
spread, or its value of the spread column was not) is counted there; all others are parts, merged by minimum over the tasks.
So few parts are sent, no day, group or identifier is a hot spot, and how many tasks there are follows from the cluster.

Defined results: null identifiers are not counted; null group values form a group of their own (``null`` with its
grouping marked in ``grouping``); rows without a day have day null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut, tasks

M, SPARSE = 1024, 512
_BITS = 10  # log2(M)


def _mix(x: np.ndarray) -> np.ndarray:
    z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def place(item: np.ndarray, k: int) -> np.ndarray:
    """The register that takes an identifier's k-th smallest value: a permutation of the registers, drawn from its hash."""
    mask = np.uint64(M - 1)
    key = _mix(item ^ np.uint64(0x5851F42D4C957F2D))
    v = np.full(len(item), k, np.uint64)
    for shift in (0, 20, 40):
        odd = ((key >> np.uint64(shift)) & mask) | np.uint64(1)
        add = (key >> np.uint64(shift + 10)) & mask
        v = (v * odd + add) & mask
        v ^= v >> np.uint64(_BITS // 2)
    return v.astype(np.int64)


def registers(group: np.ndarray, item: np.ndarray, n_groups: int, start: np.ndarray | None = None) -> np.ndarray:
    """Registers (n_groups, M) of identifiers with their group number, merged into ``start`` if given."""
    reg = np.full((n_groups, M), np.inf, np.float32) if start is None else start.copy()
    flat = reg.reshape(-1)
    with np.errstate(over="ignore"):
        seed = _mix(item + np.uint64(0x9E3779B97F4A7C15))
        value = np.zeros(len(item))
        for k in range(M):
            if not len(item):
                break
            h = _mix(seed + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF))
            u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            value = value - np.log(u) / (M - k)
            low = value < reg.max(axis=1)[group]
            if not low.all():
                group, item, seed, value = group[low], item[low], seed[low], value[low]
                if not len(item):
                    break
            np.minimum.at(flat, group * M + place(item, k), value.astype(np.float32))
    return reg


def gamma_quantile(p: float, shape: float) -> float:
    """Quantile of a gamma variable with rate 1 (Wilson-Hilferty, far within a per cent for shapes of hundreds)."""
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    z = z if p > 0.5 else -z
    return shape * (1 - 1 / (9 * shape) + z / (3 * math.sqrt(shape))) ** 3


def count_of(total: float, confidence: float = 0.95) -> tuple[float, float, float]:
    """Estimate and confidence interval from a sum of registers: total is gamma(M) / n."""
    a = (1 - confidence) / 2
    return (M - 1) / total, gamma_quantile(a, M) / total, gamma_quantile(1 - a, M) / total


PART = "g long, hashes binary, regs binary"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (g, h) or parts (g, hashes, regs), sorted by g, to one part a group. Groups may cross batches."""
    for g, item, owner, dense in _grouped(batches):
        yield _parts(g, item, owner, dense)


def _grouped(batches: Iterator[pd.DataFrame]):
    """Whole groups at a time: group keys, identifiers with their group's number, registers by group's number."""
    keep: list[pd.DataFrame] = []
    held = 0
    for pdf in batches:
        if not len(pdf):
            continue
        keep.append(pdf)
        held += len(pdf)
        if held < 50_000:
            continue
        all_ = pd.concat(keep, ignore_index=True)
        last = all_["g"].iloc[-1]
        cut = all_["g"].to_numpy() != last
        if cut.any():
            yield _load(all_[cut])
        rest = all_[~cut]
        # a group that is larger than the buffer is folded as it comes, so it never has to fit
        if len(rest) > 1:
            rest = _parts(*_load(rest))
        keep, held = [rest], 0
    if keep:
        yield _load(pd.concat(keep, ignore_index=True))


def _load(pdf: pd.DataFrame):
    keys, code = np.unique(pdf["g"].to_numpy(np.int64), return_inverse=True)
    items, owners = [], []
    if "h" in pdf:
        one = pdf["h"].notna().to_numpy()
        items.append(pdf["h"].to_numpy()[one].astype(np.int64).view(np.uint64))
        owners.append(code[one])
    if "hashes" in pdf:
        for c, b in zip(code, pdf["hashes"]):
            if b is not None and isinstance(b, bytes):
                x = np.frombuffer(b, np.uint64)
                items.append(x)
                owners.append(np.full(len(x), c))
    dense: dict[int, np.ndarray] = {}
    if "regs" in pdf:
        for c, b in zip(code, pdf["regs"]):
            if b is not None and isinstance(b, bytes):
                x = np.frombuffer(b, np.float32)
                dense[c] = np.minimum(dense[c], x) if c in dense else x
    item = np.concatenate(items) if items else np.zeros(0, np.uint64)
    owner = np.concatenate(owners).astype(np.int64) if owners else np.zeros(0, np.int64)
    if len(item):
        order = np.lexsort((item, owner))
        item, owner = item[order], owner[order]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1])
        item, owner = item[new], owner[new]
    n = np.bincount(owner, minlength=len(keys))
    big = [c for c in range(len(keys)) if n[c] > SPARSE or (c in dense and n[c])]
    for lo in range(0, len(big), 256):
        some = big[lo : lo + 256]
        number = np.full(len(keys), -1)
        number[some] = np.arange(len(some))
        mine = number[owner] >= 0
        start = np.stack([dense.get(c, np.full(M, np.inf, np.float32)) for c in some])
        for c, r in zip(some, registers(number[owner[mine]], item[mine], len(some), start)):
            dense[c] = r
    if dense:
        full = np.zeros(len(keys), bool)
        full[list(dense)] = True
        mine = ~full[owner]
        item, owner = item[mine], owner[mine]
    return keys, item, owner, dense


def _parts(keys: np.ndarray, item: np.ndarray, owner: np.ndarray, dense: dict[int, np.ndarray]) -> pd.DataFrame:
    ends = np.searchsorted(owner, np.arange(len(keys) + 1))
    hashes = [None if c in dense else item[ends[c] : ends[c + 1]].tobytes() for c in range(len(keys))]
    regs = [dense[c].tobytes() if c in dense else None for c in range(len(keys))]
    return pd.DataFrame({"g": keys, "hashes": pd.Series(hashes, dtype=object), "regs": pd.Series(regs, dtype=object)})


def _counts(n: int, dense: np.ndarray | None) -> tuple[float, float, float, bool]:
    """Estimate, interval and whether it is exact."""
    if dense is None:
        return float(n), float(n), float(n), True
    return (*count_of(float(dense.astype(np.float64).sum())), False)


def partials(pairs: DataFrame) -> DataFrame:
    """Mergeable parts (PART) of pairs ``g, h`` (group number, 64-bit hash): one a task and group, without a shuffle."""
    return pairs.where("h is not null").sortWithinPartitions("g").mapInPandas(_fold, PART)


def merge(parts: DataFrame) -> DataFrame:
    """One part a group out of any parts, by elementwise minimum."""
    return parts.select("g", "hashes", "regs").repartition("g").sortWithinPartitions("g").mapInPandas(_fold, PART)


COUNTS = "g long, estimate double, low double, high double, exact boolean"


def _estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for keys, _, owner, dense in _grouped(batches):
        n = np.bincount(owner, minlength=len(keys))
        yield pd.DataFrame([(k, *_counts(n[c], dense.get(c))) for c, k in enumerate(keys)], columns=["g", "estimate", "low", "high", "exact"])


def estimate(parts: DataFrame) -> DataFrame:
    """COUNTS of any parts, merged on the way."""
    return parts.select("g", "hashes", "regs").repartition("g").sortWithinPartitions("g").mapInPandas(_estimates, COUNTS)


def grouping_sets(by: Sequence[str]) -> list[tuple[str, ...]]:
    """All combinations of the group columns, the empty one included."""
    return [c for n in range(len(by) + 1) for c in combinations(by, n)]


def _numbers_of(values: np.ndarray) -> np.ndarray:
    """64 bits of each label, equal in every task."""
    return pd.util.hash_array(np.array(["\0null" if v is None else str(v) for v in values], dtype=object), categorize=False)


#: Where the rows of a task come from: a whole day, a day spread by the spread column, a heavy value spread by identifier.
WHOLE, SPREAD, SPLIT = 0, 1, 2


def _cells(cols: list[str], items: list[str], sets: list[tuple[int, tuple[str, ...]]], spread_by: str | None):
    """Sketches of all grouping sets of the rows of one task (a bounded share of the rows of its days).

    Cells that no other task can hold a part of come with their count, others with their part.
    """
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        del held
        codes: dict[str, np.ndarray] = {}
        names: dict[str, np.ndarray] = {}
        for c in ["day", *cols]:
            code, values = pd.factorize(pdf[c])
            codes[c] = np.where(code < 0, len(values), code)
            names[c] = np.append(np.asarray(values, dtype=object), None)
        number_of = {c: _numbers_of(v) for c, v in names.items()}
        how = pdf["_how"].to_numpy(np.int64)
        for n, item in enumerate(items):
            h = pdf[f"h{n}"].to_numpy(np.int64)
            ok = h != 0
            h = h[ok].view(np.uint64)
            mine = [s for m, s in sets if m == n]
            used = ["day", *[c for c in cols if any(c in s for s in mine)]]
            base = {c: codes[c][ok] for c in used}
            came = how[ok]
            for s in sorted(mine, key=lambda s: -len(s)):
                group = np.zeros(len(h), np.int64)
                for c in ("day", *s):
                    group = group * len(names[c]) + base[c]
                order = np.lexsort((h, group))
                g, x = group[order], h[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
                order, g, x = order[new], g[new], x[new]
                if not len(g):
                    continue
                head = np.ones(len(g), bool)
                head[1:] = g[1:] != g[:-1]
                at = np.flatnonzero(head)
                owner = np.cumsum(head) - 1
                count = np.diff(np.append(at, len(g)))
                first = order[at]
                big = np.flatnonzero(count > SPARSE)
                dense: dict[int, np.ndarray] = {}
                for lo in range(0, len(big), 128):
                    some = big[lo : lo + 128]
                    number = np.full(len(at), -1)
                    number[some] = np.arange(len(some))
                    m = number[owner] >= 0
                    for c, r in zip(some, registers(number[owner[m]], x[m], len(some))):
                        dense[int(c)] = r
                out = pd.DataFrame({"day": names["day"][base["day"][first]], "grouping": ",".join(s)})
                for c in cols:
                    out[c] = names[c][base[c][first]] if c in s else None
                out["item"] = item
                done = came[first] <= (SPREAD if spread_by in s else WHOLE)
                est = [np.array(count, float), np.array(count, float), np.array(count, float)]
                exact = np.ones(len(at), bool)
                for c, r in dense.items():
                    *v, _ = _counts(0, r)
                    exact[c] = False
                    for a, b in zip(est, v):
                        a[c] = b
                out["estimate"], out["low"], out["high"] = (np.where(done, e, np.nan) for e in est)
                out["exact"] = exact
                out["done"] = done
                out["g"], out["hashes"], out["regs"] = np.int64(0), None, None
                open_ = np.flatnonzero(~done)
                if len(open_):
                    ends = np.append(at, len(g))
                    z = _numbers_of(np.array([f"{item}|{','.join(s)}"], dtype=object))
                    with np.errstate(over="ignore"):
                        for c in ("day", *s):
                            z = _mix(z * np.uint64(0x9E3779B97F4A7C15) + number_of[c][base[c][first[open_]]])
                    out.loc[open_, "g"] = z.view(np.int64)
                    hashes, regs = np.full(len(at), None, object), np.full(len(at), None, object)
                    for c in open_:
                        if c in dense:
                            regs[c] = dense[c].tobytes()
                        else:
                            hashes[c] = x[ends[c] : ends[c + 1]].tobytes()
                    out["hashes"], out["regs"] = hashes, regs
                for lo in range(0, len(out), 20_000):
                    yield out.iloc[lo : lo + 20_000]
                if len(s) == max(map(len, mine)) and len(mine) > 1 and set(s) == set(used) - {"day"}:
                    base, h, came = {c: v[order] for c, v in base.items()}, x, came[order]  # coarser sets need each pair of a cell once
    return go


def _hash(c: Column) -> Column:
    """64 bits of an identifier; 0 for none (nulls would make the column one of floats, which hold 53 bits)."""
    h = F.xxhash64(c)
    return F.when(c.isNull(), 0).when(h == 0, 1).otherwise(h).cast("long")


def spread(days: list[tuple[object, int]], target: int) -> tuple[list[tuple[object, int, int]], int]:
    """(day, first task, tasks) so that no task gets much more than ``target`` rows; small days share a task."""
    out, at, room = [], 0, 0
    for day, n in days:
        if n >= target:
            k = math.ceil(n / target)
            out.append((day, at + (room > 0), k))
            at, room = at + (room > 0) + k, 0
        else:
            if room and n > room:
                at, room = at + 1, 0
            room = room or target
            out.append((day, at, 1))
            room -= n
            if room <= 0:
                at, room = at + 1, 0
    return out, at + (room > 0)


def distinct_counts(
    df: DataFrame, day: str, items: Sequence[str], by: Sequence[str], alone: Sequence[str] = (), target: int | None = None, spread_by: str | None = None,
) -> DataFrame:
    """Distinct items per day and every combination of ``by``, and per day and each column of ``alone``.

    An item that is itself a column of ``by`` is counted by the combinations of the others: within one of its own values
    there is one of it.

    target: rows a task gets about; without it four tasks for each reduce task of the session share the rows, at most a
    million each. spread_by: the column of ``by`` whose values a large day is spread by, best the one with most (default: the first).

    Result: ``day, grouping`` (names of the columns grouped by), the group columns as strings, ``item`` (name of the
    counted column), ``estimate, low, high`` (95 % interval), ``exact``.
    """
    spark = df.sparkSession
    cols = [*by, *[a for a in alone if a not in by]]
    spread_by = spread_by or (by[0] if by else None)
    sets = [(n, s) for n, i in enumerate(items) for s in grouping_sets([c for c in by if c != i])] + [(n, (a,)) for a in alone for n, i in enumerate(items) if i != a and a not in by]
    rows = df.select(F.col(day).alias("day"), *[F.col(c).cast("string").alias(c) for c in cols], *[_hash(F.col(i)).alias(f"h{n}") for n, i in enumerate(items)])
    value = F.col(spread_by).cast("string") if spread_by else F.lit(None).cast("string")
    load = cut(df.groupBy(F.col(day).alias("day"), value.alias("v")).agg(F.count(F.lit(1)).alias("n")), name="load")  # a row a day and value, read twice
    days = sorted(((r["day"], r["n"]) for r in load.groupBy("day").agg(F.sum("n").alias("n")).collect()), key=lambda x: str(x[0]))  # one row a day
    if target is None:
        target = max(1, min(1_000_000, math.ceil(sum(n for _, n in days) / (4 * tasks(spark)))))
    placed, n_tasks = spread(days, target)
    kind = df.schema[day].dataType.simpleString()
    final = ", ".join([f"day {kind}", "grouping string", *[f"{c} string" for c in cols], "item string", "estimate double", "low double", "high double", "exact boolean"])
    if not placed:
        return spark.createDataFrame([], final)
    at = spark.createDataFrame(placed, f"_d {kind}, _a int, _k int")  # a row a day
    heavy = load.where(F.col("n") > target / 2).select(F.col("day").alias("_hd"), F.col("v").alias("_hv"), F.lit(True).alias("_heavy"))  # at most 2 * rows / target
    x = rows.join(F.broadcast(at), F.col("day").eqNullSafe(F.col("_d")))
    x = x.join(F.broadcast(heavy), F.col("day").eqNullSafe(F.col("_hd")) & (F.col(spread_by) if spread_by else F.lit(None).cast("string")).eqNullSafe(F.col("_hv")), "left")
    how = F.when(F.col("_k") == 1, WHOLE).when(F.col("_heavy").isNull(), SPREAD).otherwise(SPLIT)
    to = F.when(how == WHOLE, 0).when(how == SPREAD, F.pmod(F.xxhash64(F.lit("spread"), spread_by or F.lit(0)), F.col("_k"))).otherwise(F.pmod(F.xxhash64(F.lit("split"), *[f"h{n}" for n in range(len(items))]), F.col("_k")))
    sent = x.select("day", *cols, *[f"h{n}" for n in range(len(items))], how.cast("int").alias("_how"), (F.col("_a") + to).cast("int").alias("_to")).repartitionById(n_tasks, "_to").drop("_to")
    cells = sent.mapInPandas(_cells(cols, list(items), sets, spread_by), f"{final}, done boolean, g long, hashes binary, regs binary")
    result = ["day", "grouping", *cols, "item", "estimate", "low", "high", "exact"]
    if all(k == 1 for _, _, k in placed):
        return cells.select(*result)
    cells = cut(cells, name="sketches")
    parts = cells.where("not done")
    names = parts.select("g", "day", "grouping", *cols, "item").dropDuplicates(["g"])
    return cells.where("done").select(*result).unionByName(names.join(estimate(parts), "g").drop("g"))
