"""Hierarchies against a brute-force walk, and the defined edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import hierarchy as H

SCHEMA = "trace_id string, span_id string, parent_span_id string, row_id long, ingested_at long, g string, k string, status string"


def frame(spark, rows):
    return spark.createDataFrame([(t, s, p, i, i, "x", "y", "z") for i, (t, s, p) in enumerate(rows)], SCHEMA)


def brute(rows):
    """Follow parents one by one."""
    up, shown = {}, {}
    clean = lambda x: None if x is None or x.strip() in ("", "-") else x.strip().lower()
    for t, s, p in rows:
        if clean(t) and clean(s):
            up[clean(t), clean(s)] = clean(p)
            shown.setdefault((clean(t), clean(s)), s)
    out = {}
    for t, s in up:
        path, at = [], s
        while at is not None and (t, at) in up and at not in path:
            path.append(at)
            at = up[t, at]
        if at is None or (t, at) not in up:
            out[t, s] = ("tree", [shown[t, x] for x in path[::-1]])
        else:
            out[t, s] = ("cycle" if at == s else "leads_to_cycle", None)
    return out


def got(df):
    return {(r["trace_id"], r["span_id"].strip().lower()): (r["status"], list(r["path"]) if r["path"] is not None else None) for r in df.collect()}


@pytest.mark.parametrize("limit", [1000, 4])
def test_random_forests(spark, limit):
    rng = random.Random(4)
    rows = []
    for t in range(6):
        ids = [f"s{t}{i}" for i in range(14)]
        rows += [(f"T{t}", s, rng.choice([*ids, None, "-", "", "lost"])) for s in ids]
    df = frame(spark, rows)
    tree = H.hierarchy(df, max_task_nodes=limit)
    want = {(t.lower(), s): v for (t, s), v in brute(rows).items()}
    assert got(tree) == want
    size = {(r["trace_id"], r["span_id"]): r["subtree_size"] for r in tree.collect()}
    pairs = {}
    for r in H.descendants(tree).collect():
        pairs.setdefault((r["trace_id"], r["ancestor_id"]), set()).add(r["descendant_id"])
        assert r["distance"] >= 1
    for (t, s), (status, path) in want.items():
        if status == "tree":
            assert size[t, s] == 1 + len(pairs.get((t, s), ()))
        elif status == "cycle":
            assert size[t, s] is None


def test_case_blank_repeats_and_self(spark):
    rows = [("T", "AA", None), ("t", "aa", None), ("t", "bb", " Aa "), ("t", "me", "ME"), ("t", "kid", "me"), (None, "x", None), ("t", None, "aa"), ("t", " ", None)]
    assert got(H.hierarchy(frame(spark, rows))) == {("t", "aa"): ("tree", ["AA"]), ("t", "bb"): ("tree", ["AA", "bb"]), ("t", "me"): ("cycle", None), ("t", "kid"): ("leads_to_cycle", None)}


def test_latest_parent_counts_and_empty(spark):
    rows = [("t", "a", None), ("t", "b", None), ("t", "b", "a")]
    assert got(H.hierarchy(frame(spark, rows)))["t", "b"] == ("tree", ["a", "b"])
    assert H.hierarchy(frame(spark, rows).limit(0)).count() == 0


def test_deep_chain_streams_out(spark):
    rows = [("t", f"n{i}", f"n{i - 1}" if i else None) for i in range(900)]
    tree = H.hierarchy(frame(spark, rows))
    assert tree.agg({"depth": "max"}).first()[0] == 899
    assert tree.where("span_id = 'n0'").first()["subtree_size"] == 900


def test_large_ring(spark):
    rows = [("t", f"n{i}", f"n{(i + 1) % 12}") for i in range(12)] + [("t", "leaf", "n3")]
    out = got(H.hierarchy(frame(spark, rows), max_task_nodes=5))
    assert sum(v == ("cycle", None) for v in out.values()) == 12 and out["t", "leaf"] == ("leads_to_cycle", None)


@pytest.mark.parametrize("limit", [1000, 4])
def test_descendants_outside_trees(spark, limit):
    rng = random.Random(11)
    rows = [("t", "a", "b"), ("t", "B", "c"), ("t", "c", "A"), ("t", "d", "b"), ("t", "e", "d"), ("t", "f", "E"), ("t", "me", "me"), ("t", "kid", "me"), ("t", "root", None), ("t", "leaf", "root")]
    for t in range(4):
        ids = [f"s{i}" for i in range(12)]
        rows += [(f"u{t}", s, rng.choice([*ids, None])) for s in ids]
    up = {(t, s.lower()): (t, p.lower()) for t, s, p in rows if p is not None}
    shown = {(t, s.lower()): s for t, s, _ in rows}
    want = set()
    for t, s in shown:
        seen, at = [(t, s)], up.get((t, s))
        while at in shown and at not in seen:
            want.add((t, shown[at], shown[t, s], len(seen)))
            seen.append(at)
            at = up.get(at)
    tree = H.hierarchy(frame(spark, rows), max_task_nodes=limit)
    out = [tuple(r) for r in H.descendants(tree, max_task_nodes=limit).collect()]
    assert len(out) == len(set(out)) and set(out) == want
    assert {("t", "d", "f", 2), ("t", "B", "f", 3), ("t", "c", "f", 4), ("t", "a", "f", 5), ("t", "me", "kid", 1), ("t", "a", "c", 1)} <= want
    below = {}
    for t, a, d, _ in out:
        below[t, a] = below.get((t, a), 0) + 1
    assert all(r["subtree_size"] == 1 + below.get((r["trace_id"], r["span_id"]), 0) for r in tree.where("status <> 'cycle'").collect())


@pytest.mark.parametrize("limit", [1000, 3])
def test_white_space_of_any_kind_in_large_traces(spark, limit):
    rows = [("t", "\ttop\n", None), ("t", "mid\n", "top"), ("t", "low", "\tMID"), ("t", "leaf", "low\t"), ("t", "x\n", "y"), ("t", "\ty", "x"), ("t", "hung", "\nx"), ("t", "end", "hung")]
    want = {(t, s): v for (t, s), v in brute(rows).items()}
    assert got(H.hierarchy(frame(spark, rows), max_task_nodes=limit)) == want


def messy(rng, n, traces):
    """Random links with rings, lost parents, tabs, letter case and repeated rows."""
    rows = []
    for t in range(traces):
        ids = [f"s{i}" for i in range(n)]
        for i, s in enumerate(ids):
            up = ids[i - 1] if i and rng.random() < 0.6 else rng.choice([*ids, None, "-", "lost"])
            rows.append((f"T{t}", rng.choice([s, s.upper(), f" {s}\t", f"\n{s}"]), up and rng.choice([up, up.upper(), f"{up}\t"])))
        rows += [(f"t{t}", ids[0].upper(), None), (f"t{t}", ids[n // 2], ids[0])]
    return rows


def test_one_answer_whatever_the_limit(spark, few):
    rng = random.Random(21)
    df = spark.createDataFrame([(t, s, p, i, i, rng.randrange(5) or None) for i, (t, s, p) in enumerate(messy(rng, 17, 4))], "trace_id string, span_id string, parent_span_id string, row_id long, ingested_at long, start_ms long")
    seen = []
    for limit in (2, 7, 10**6):
        all_ = [H.hierarchy(df, max_task_nodes=limit), H.descendants_of(df, max_task_nodes=limit), H.depth_first(df, "start_ms", max_task_nodes=limit), H.descendants(H.hierarchy(df), max_task_nodes=limit)]
        seen.append([sorted(map(str, x.collect())) for x in all_])
        assert seen[-1] == seen[0] and seen[-1][1] == seen[-1][3]
    assert len(seen[0][0]) == 4 * 17 and any("cycle" in x for x in seen[0][0])


def test_chain_beyond_a_task(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("t").alias("trace_id"), F.concat(F.lit("n"), "id").alias("span_id"), F.when(F.col("id") > 0, F.concat(F.lit("N"), F.col("id") - 1)).alias("parent_span_id"), F.col("id").alias("row_id"), F.col("id").alias("ingested_at"))
    tree = H.hierarchy(df, max_task_nodes=1000, paths=False)  # the paths of this chain have 5 billion elements
    r = tree.agg(F.count("*"), F.sum("depth"), F.sum("subtree_size"), F.count_if(F.col("status") == "tree"), F.count_distinct("root_id")).first()
    assert tuple(r) == (n, n * (n - 1) // 2, n * (n + 1) // 2, n, 1)


def test_lists_are_complete_and_disjoint_sends():
    rng = random.Random(2)
    for n in (1, 2, 30):
        parent = [rng.randrange(-1, n) for _ in range(n)]
        want = set()
        for i in range(n):
            seen, j = [i], parent[i]
            while j >= 0 and j not in seen:
                want.add((j, i, len(seen)))
                seen.append(j)
                j = parent[j]
        got = [(int(a), int(b), int(c)) for x, y, z in H.lists(np.array(parent)) for a, b, c in zip(x, y, z)]
        assert len(got) == len(set(got)) and set(got) == want
