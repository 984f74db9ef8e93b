"""Distinct counts and heavy hitters against exact answers."""

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import expsketch as X
from spanloom.llm import heavyhitters as HH


def test_counts_are_unbiased_and_covered():
    rng = np.random.default_rng(2)
    for n in (700, 5000, 50_000):
        err, inside = [], 0
        for _ in range(25):
            reg = X.registers(np.zeros(n, np.int64), rng.integers(0, 2**63, n).astype(np.uint64), 1)
            est, low, high = X.count_of(float(reg.astype(float).sum()))
            err.append(est / n - 1)
            inside += low <= n <= high
        assert abs(np.mean(err)) < 0.025 and np.std(err) < 0.06 and inside >= 20


def test_registers_merge_and_ignore_repeats():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    one = X.registers(np.zeros(3000, np.int64), x, 1)
    a, b = X.registers(np.zeros(2000, np.int64), x[:2000], 1), X.registers(np.zeros(1500, np.int64), x[1500:], 1)
    assert np.array_equal(np.minimum(a, b), one)
    assert np.array_equal(X.registers(np.zeros(6000, np.int64), np.tile(x, 2), 1), one)
    places = np.stack([X.place(x[:4], k) for k in range(X.M)])
    assert all(len(set(places[:, j])) == X.M for j in range(4))


def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(9000):
        d = None if rng.random() < 0.02 else f"2026-06-0{1 + int(rng.random() ** 3 * 5)}"
        rows.append((d, [None, "a", "b"][rng.integers(3)], int(rng.integers(3)), None if rng.random() < 0.05 else int(rng.integers(4000)), int(rng.integers(20)), "x"))
    return spark.createDataFrame(rows, "day string, kind string, db int, item long, inst long, g string").repartition(6)


def test_every_combination_and_equal_however_days_are_cut(spark):
    df = frame(spark)
    whole = X.distinct_counts(df, "day", ["item", "inst"], ["kind", "db"], ["inst"], target=100_000).collect()
    cut = X.distinct_counts(df, "day", ["item", "inst"], ["kind", "db"], ["inst"], target=700).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in (r["day"], r["grouping"], r["kind"], r["db"], r["inst"], r["item"]))
    assert sorted((key(r), round(r["estimate"], 3), r["exact"]) for r in whole) == sorted((key(r), round(r["estimate"], 3), r["exact"]) for r in cut)
    assert {r["grouping"] for r in whole} == {"", "kind", "db", "kind,db", "inst"}
    got = {key(r): r for r in whole}
    assert len(got) == len(whole)
    for by, name in ((["day"], ""), (["day", "kind"], "kind"), (["day", "kind", "db"], "kind,db")):
        for r in df.groupBy(*by).agg(F.count_distinct("item").alias("n")).collect():
            v = got[tuple("" if x is None else str(x) for x in (r["day"], name, r["kind"] if "kind" in by else None, r["db"] if "db" in by else None, None, "item"))]
            assert v["estimate"] == r["n"] if v["exact"] else abs(v["estimate"] / r["n"] - 1) < 0.15


def test_counted_column_among_the_groups(spark):
    df = frame(spark)
    for target in (100_000, 700):
        rows = X.distinct_counts(df, "day", ["item", "inst"], ["inst", "kind", "db"], target=target).collect()
        assert {r["grouping"] for r in rows if r["item"] == "item"} == {",".join(s) for s in X.grouping_sets(["inst", "kind", "db"])}
        assert {r["grouping"] for r in rows if r["item"] == "inst"} == {",".join(s) for s in X.grouping_sets(["kind", "db"])}
        for item, by in (("item", ["inst", "kind", "db"]), ("item", ["inst", "db"]), ("item", ["kind"]), ("inst", ["kind", "db"])):
            want = {tuple(None if x is None else str(x) for x in r[:-1]): r["n"] for r in df.where(f"{item} is not null").groupBy("day", *by).agg(F.count_distinct(item).alias("n")).collect()}
            mine = [r for r in rows if r["item"] == item and r["grouping"] == ",".join(by)]
            got = {(r["day"], *[r[c] for c in by]): r for r in mine}
            assert len(got) == len(mine) and set(got) == set(want)
            assert all(r["estimate"] == want[k] if r["exact"] else abs(r["estimate"] / want[k] - 1) < 0.15 for k, r in got.items())


def test_fingerprints_by_all_sixteen_combinations(spark, tmp_path):
    from spanloom.llm.queries import p4_distinct

    df = spark.createDataFrame([(1, 7, 4, 2, "Select", "2026-06-01 00:00:00", "f"), (2, None, 4, 2, "select", "2026-06-01 01:00:00", "g")], "query_id long, instance_id long, cluster_size int, database_id int, query_type string, arrival_ts string, feature_fingerprint string")
    df.withColumn("arrival_ts", F.to_timestamp("arrival_ts")).write.parquet(str(tmp_path / "r.parquet"))
    sets = {"feature_fingerprint": set(), "instance_id": set()}
    for r in p4_distinct(spark, str(tmp_path)).collect():
        sets[r["item"]].add(r["grouping"])
    assert len(sets["feature_fingerprint"]) == 16 and "instance_id,query_type,database_id,cluster_size" in sets["feature_fingerprint"] and len(sets["instance_id"]) == 8


def test_no_rows(spark):
    assert X.distinct_counts(frame(spark).limit(0), "day", ["item"], ["kind"]).count() == 0


def test_parts_merge_in_any_order(spark):
    pairs = spark.range(8000).select((F.col("id") % 3).alias("g"), F.xxhash64((F.col("id") % 2500)).alias("h"))
    counts = {r["g"]: r for r in X.estimate(X.merge(X.partials(pairs.repartition(5)))).collect()}
    assert set(counts) == {0, 1, 2} and all(abs(r["estimate"] / 2500 - 1) < 0.15 and r["low"] < r["estimate"] < r["high"] for r in counts.values())


def test_heavy_hitters_are_exact_after_the_second_scan(spark):
    rng = np.random.default_rng(8)
    items = [f"h{i}" for i in range(6) for _ in range(400 - 60 * i)] + [f"t{x}" for x in rng.integers(0, 9000, 12_000)] + [None] * 3000 + ["", ""] * 100
    df = spark.createDataFrame([(x, 1, "k") for x in items], "v string, n int, h string").repartition(7)
    total = sum(x is not None for x in items)
    want = {x: items.count(x) for x in ["", *[f"h{i}" for i in range(6)]]}
    got = {r["item"]: r["n"] for r in HH.heavy_hitters(df, "v", 0.01).collect()}
    assert got == {x: n for x, n in want.items() if n >= 0.01 * total}
    assert HH.heavy_hitters(df.limit(0), "v", 0.01).count() == 0
    assert HH.heavy_hitters(df.where("v is null"), "v", 0.01).count() == 0


def test_ties_and_numbers(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("x"))
    assert sorted((r["item"], r["n"]) for r in HH.heavy_hitters(df, "x", 0.1).collect()) == [(i, 100) for i in range(10)]


def test_recall_over_hash_families():
    """Every item above the threshold is found under 40 families of hash functions, over skewed items and ties."""
    rng = np.random.default_rng(12)
    n = np.concatenate([rng.integers(1, 30, 30_000), [1200] * 20, [1100] * 10, [30_000, 9000]]).astype(np.int64)
    items = rng.integers(0, 2**63, len(n)).astype(np.uint64) * np.uint64(2)
    share = 1200 / n.sum()  # twenty items exactly at the threshold
    want = set(items[n >= share * n.sum()].tolist())
    assert len(want) == 22
    for seed in range(40):
        sk = HH.sketch(items, n, HH.LEVELS, HH.ROWS, HH.width_for(share), seed)
        assert want <= set(HH.descend(sk, share * n.sum(), HH.LEVELS, 0.8, seed).tolist())


def test_sketches_of_many_tasks_add_up(spark):
    df = spark.range(20_000).select((F.col("id") % 97).alias("x"))
    n, one = HH.build(df.coalesce(1), "x", width=2048)
    m, many = HH.build(df.repartition(150), "x", width=2048)
    assert n == m == 20_000 and np.array_equal(one, many)


def test_parts_of_tasks_hold_whole_hashes(spark):
    """Nulls beside the identifiers, days over many tasks, heavy and light values: every count up to SPARSE is exact."""
    rng = np.random.default_rng(4)
    rows = [(f"d{rng.integers(2)}", None if i % 11 == 0 else int(7 if i % 3 else rng.integers(60)), f"k{i % 4}", None if i % 13 == 0 else int(rng.integers(300)), None if i % 17 == 0 else int(rng.integers(90))) for i in range(6000)]
    df = spark.createDataFrame(rows, "day string, inst long, kind string, item long, other long").repartition(5)
    for target in (10**6, 400, 90):
        got = {(r["day"], r["grouping"], r["inst"], r["kind"], r["item"]): r["estimate"] for r in X.distinct_counts(df, "day", ["item", "other"], ["inst", "kind"], target=target).collect()}
        for name in ("item", "other"):
            for by in ([], ["inst"], ["kind"], ["inst", "kind"]):
                for r in df.where(f"{name} is not null").groupBy("day", *by).agg(F.count_distinct(name).alias("n")).collect():
                    key = (r["day"], ",".join(by), None if "inst" not in by or r["inst"] is None else str(r["inst"]), r["kind"] if "kind" in by else None, name)
                    assert got[key] == r["n"], (target, key)


def test_days_alone(spark):
    df = frame(spark)
    for target in (10**6, 500):
        got = {r["day"]: r for r in X.distinct_counts(df, "day", ["inst"], [], target=target).collect()}
        assert {d: r["estimate"] for d, r in got.items()} == {r["day"]: r["n"] for r in df.groupBy("day").agg(F.count_distinct("inst").alias("n")).collect()}


def test_packed_counters_come_back():
    rng = np.random.default_rng(1)
    for top in (0, 9, 2**15 - 1, 2**15, 2**31 - 1, 2**31, 2**50):
        x = np.zeros(HH.PIECE, np.int64)
        x[:2] = top, -top
        x[2:] = rng.integers(-top, top + 1, HH.PIECE - 2)
        assert np.array_equal(HH._unpacked(HH._packed(x)), x)
