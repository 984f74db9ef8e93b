"""Billing identities, guard, shapes, soundness of rollup answers, client, streaming."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom import client, reports
from spanloom.operators import billing as B
from spanloom.operators import fleet, grounding, lineage, measured
from spanloom.plans import rollup as R
from spanloom.plans.sqlplan import Shape, refusal, try_shape
from spanloom.streaming import windows as W


def spans(spark, rows):
    return spark.createDataFrame(rows, "k string, id string, start_ms long, exec_ms double")


def test_billing_identities(spark):
    df = spans(spark, [("a", "1", 0, 1000.0), ("a", "2", 61_000, 500.0), ("a", "3", 121_501, 100.0), ("b", "1", 5, None), (None, "1", 5, 10.0), ("a", "x", None, 5.0)])
    b = {r["k"]: r for r in B.bill(df, ["k"], "id").collect()}
    assert b["a"]["windows"] == 2 and b["a"]["spans"] == 3  # the tie of 60 s stays in the window, 60.001 s does not
    assert b["a"]["billed_s"] == pytest.approx(61.5 + 60 + 60.1) and b["a"]["productive_s"] == pytest.approx(1.6)
    assert b["a"]["overhead_s"] + b["a"]["productive_s"] == pytest.approx(b["a"]["billed_s"]) and b["b"]["billed_s"] == 60
    parts = B.attribute(df, ["k"], "id")
    for r in parts.groupBy("k").agg(F.sum("billed_s").alias("s"), F.sum("cost").alias("c")).collect():
        assert r["s"] == pytest.approx(b[r["k"]]["billed_s"]) and r["c"] == pytest.approx(b[r["k"]]["dollars"])
    longer = {r["k"]: r for r in B.bill(df, ["k"], "id", dilation=10).collect()}
    assert longer["a"]["productive_s"] == pytest.approx(b["a"]["productive_s"]) and longer["a"]["elapsed_s"] > b["a"]["elapsed_s"]


def test_overlap_is_busy_once(spark):
    r = B.bill(spans(spark, [("a", "1", 0, 10_000.0), ("a", "2", 2000, 3000.0), ("a", "3", 9000, 4000.0)]), ["k"], "id").first()
    assert (r["productive_s"], r["busy_s"], r["elapsed_s"]) == pytest.approx((17.0, 13.0, 13.0))


@pytest.mark.parametrize("sql,ok", [("select 1", True), ("select ';' ;", True), ("select 1; drop table t", False), ("create table x as select 1", False), ("", False), ("selec", False), ("with a as (select 1) select * from a", True), ("select distinct on (a) a from t", False), ("show tables", False)])
def test_guard(spark, sql, ok):
    assert (refusal(spark, sql) is None) == ok


@pytest.mark.parametrize("sql", ["select * from t", "select a from t", "select count(*) from a join b on a.x = b.x", "with c as (select 1) select count(*) from c", "select count(*) from t where a = 1 or b = 2", "select a, count(*) from t group by a having count(*) > 1", "nonsense",
                                 "select sum(a) over () from t", "select count(*) from t where a in (select 1)", "select count(*) from (select 1)", "select count(*) from t; select 1", "select distinct count(*) from t", "select count(*) filter (where a > 1) from t", "select count(*) from t union all select 1", "select sum(a) / count(*), count(*) from t"])
def test_declined(spark, sql):
    assert try_shape(spark, sql)[0] is None


def test_resolution(spark):
    a, _ = try_shape(spark, "select date_trunc('month', d) as m, sum(x) from t where r = 'A' and k in (1, 2) group by 1")
    b, _ = try_shape(spark, "select date_trunc('month', d) as m, sum(x) from t z where z.k in (1, 2) and z.r = 'A' group by m")
    assert a == b and a.groupby == ("date_trunc('month', d)",) and a.eq_cols == ("r",)
    assert try_shape(spark, "select d::date, count(*) from t group by d::date")[0].groupby == ("d::date",)
    assert try_shape(spark, "select sum((a + b) * c) from t")[0].measures != try_shape(spark, "select sum(a + b * c) from t")[0].measures
    assert try_shape(spark, "select count(*) filter (where a > 1) from t", "parity")[0] is not None


def sh(m, g=(), f=(), t="t"):
    return Shape(t, tuple(m), tuple(g), tuple(f), tuple(x.split(" =")[0] for x in f if " = " in x))


CASES = [
    (sh(["count(*)", "sum(x)"], ["d"]), sh(["sum(x)"], [], ["d = 1"]), True), (sh(["count(*)", "sum(x)"], ["c", "r"]), sh(["sum(x)"], ["c"], ["r = 'A'"]), True), (sh(["count(*)", "sum(x)"], ["d"]), sh(["avg(x)"], ["d"]), True),
    (sh(["count(*)"], ["d", "r"]), sh(["count(*)"], ["r"]), True), (sh(["count(*)"], ["d"]), sh(["count(*)"], ["date_trunc('month', d)"]), True), (sh(["count(*)"], ["date_trunc('month', d)"]), sh(["count(*)"], ["d"]), False),
    (sh(["count(*)"], ["d"]), sh(["count(*)"], [], ["r = 'A'"]), False), (sh(["count(*)"], ["d"], ["r = 'A'"]), sh(["count(*)"], ["d"]), False), (sh(["count(*)"], ["d"], t="u"), sh(["count(*)"], ["d"]), False),
    (sh(["count(*)"], ["d"]), sh(["sum(x)"], ["d"]), False), (sh(["avg(x)"], ["d"]), sh(["avg(x)"], ["d"]), False), (sh(["count(distinct x)"], ["d"]), sh(["count(distinct x)"]), False), (sh(["count(distinct x)"]), sh(["count(distinct x)"]), True),
    (sh(["count(*)"], ["d"]), sh(["count(*)"], [], ["d >= 1"]), False),
]


def test_matching_both_ways(spark):
    anchors = R.frame(spark, enumerate(c[0] for c in CASES)).select(F.col("shape_id").alias("i"), F.struct("table", "filters", R.offers_column().alias("have")).alias("a"))
    queries = R.frame(spark, enumerate(c[1] for c in CASES)).select(F.col("shape_id").alias("i"), F.struct("table", "filters", R.needs_column().alias("need")).alias("q"))
    got = {r["i"]: r["ok"] for r in anchors.join(queries, "i").select("i", R.subsumes_column().alias("ok")).collect()}
    for i, (a, q, want) in enumerate(CASES):
        assert R.subsumes(a, q) == want == got[i], CASES[i]


def test_answers_are_sound(spark):
    """Every claimed match is executed both ways, with nulls in the measured column."""
    rng = random.Random(9)
    rows = [(rng.randrange(6), rng.choice("ABC"), rng.choice("xyz"), None if rng.random() < 0.2 else rng.randrange(100)) for _ in range(500)]
    t = spark.createDataFrame(rows, "d int, r string, c string, x int")
    t.createOrReplaceTempView("t")
    pick = lambda xs: [x for x in xs if rng.random() < 0.5]
    tried = 0
    while tried < 12:
        a = sh(sorted({"count(*)", *pick(["sum(x)", "min(x)", "max(x)", "count(x)"])}), sorted(pick(["d", "r", "c"])), pick(["r = 'A'"]))
        q = sh(sorted(pick(["count(*)", "sum(x)", "avg(x)", "min(x)", "max(x)", "count(x)"]) or ["count(*)"]), sorted(pick(["d", "r", "c"])), pick(["r = 'A'", "c = 'x'"]))
        if not R.subsumes(a, q):
            continue
        tried += 1
        cols = [*q.groupby, *q.measures]
        want = {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in spark.sql(q.sql()).collect()}
        got = {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in R.answer(R.build(t, a), a, q).select(*[f"`{c}`" for c in cols]).collect()}
        assert got == want, (a, q)
    with pytest.raises(ValueError):
        R.answer(t, CASES[6][0], CASES[6][1])


def test_cover(spark):
    probes = [(i, sh(["sum(x)"], [], [f"d = {i}"])) for i in range(31)]
    chosen = R.cover(R.frame(spark, probes))
    assert len(chosen) == 1 and chosen[0][1] and len(chosen[0][2]) == 31
    two = R.cover(R.frame(spark, [*probes, (40, sh(["count(*)"], ["k"], t="u"))]))
    assert len(two) == 2 and all(R.subsumes(s, dict([*probes, (40, sh(["count(*)"], ["k"], t="u"))])[i]) for s, _, got in two for i in got)
    assert R.cover(R.frame(spark, [(0, sh(["avg(x)"], ["d"], ["d >= 1"]))])) == []
    ratios = {r["kind"]: (r["total"], r["distinct"]) for r in R.subexpression_ratios(R.subexpressions(R.frame(spark, probes[:2]))).collect()}
    assert ratios == {"scan": (2, 1), "filter": (2, 2), "filtered_scan": (2, 2), "measure": (2, 1), "full_agg": (2, 2), "all": (10, 6)}
    assert reports.same_task_lines(*reports.same_task(spark, probes[:2]))[-1] == "verdict: does not reproduce"
    assert fleet.verdict(0.2) == "reproduces" and fleet.verdict(0.5) == "does not reproduce"


def test_cover_of_a_table(spark, tmp_path):
    """Match and covering set of all statements against every pair and the plain greedy choice, equal shapes folded."""
    from spanloom.analysis_queries import cover_anchors, span_candidate_dims, span_cover_edges
    from spanloom.plans import extract

    rng = random.Random(5)
    some = lambda xs, least=0: rng.sample(xs, rng.randint(least, len(xs)))
    rows = []
    for i in range(160):
        g, m = some(["r", "c", "date_trunc('month', d)", "d"]), some(["sum(x)", "count(*)", "avg(x)", "max(y)", "count(distinct z)"], 1)
        f = some(["r = 'A'", "c = 'x'", "d >= 3", "r <> 'B'", "d = 4"])[:2]
        rows.append((i, f"t{i % 9}", f"s{i}", "select " + ", ".join(g + m) + f" from {rng.choice('tu')}" + (" where " + " and ".join(f) if f else "") + (" group by " + ", ".join(g) if g else ""), 1))
    rows += [(200 + i, "x", f"s{i}", rows[3][3], 1) for i in range(7)] + [(300, "x", "no", "not sql", 1)]
    spark.createDataFrame(rows, "row_id long, trace_id string, span_id string, sql_text string, ingested_at long").write.parquet(str(tmp_path / "spans.parquet"))
    folded = {}
    for i, _, _, sql, _ in rows[:-1]:
        s = extract.shape_of(sql)
        folded.setdefault(s, []).append(i)
    shapes = {ids[0]: s for s, ids in folded.items()}
    n = {ids[0]: len(ids) for ids in folded.values()}
    edges = {(r["anchor_id"], r["shape_id"]): r["statements"] for r in span_cover_edges(spark, str(tmp_path)).collect()}
    assert edges == {(a, q): n[q] for a in shapes for q in shapes if R.subsumes(shapes[a], shapes[q])}
    dims = {(s.table, "|".join(sorted({*s.groupby, *s.eq_cols}))) for s in shapes.values()}
    assert {(r["table"], r["dims"]) for r in span_candidate_dims(spark, str(tmp_path)).where("not all_dims").collect()} == dims
    pool = {tuple(-1 if x is None else x for x in r["rank"]): Shape(r["table"], tuple(r["measures"]), tuple(r["groupby"]), tuple(r["filters"])) for r in R.pool(R.frame(spark, shapes.items())).collect()}
    pairs, left, want = {k: {q for q in shapes if R.subsumes(a, shapes[q])} for k, a in pool.items()}, set(shapes), []
    while True:
        best = max(sorted(pairs), key=lambda k: sum(n[q] for q in pairs[k] & left))
        if not pairs[best] & left:
            break
        want += [(pool[best].sql(), q) for q in pairs[best] & left]
        left -= pairs[best]
    got = cover_anchors(spark, str(tmp_path)).collect()
    assert all(r["statements"] == n[r["shape_id"]] for r in got)
    assert {(r["shape_id"], r["sql"]) for r in got} == {(q, sql) for sql, q in want} and max(r["anchor_no"] for r in got) == len({r["sql"] for r in got})
    first = {}
    for r in sorted(got, key=lambda r: (r["anchor_no"], r["shape_id"])):
        first.setdefault(r["anchor_no"], r["sql"])
    assert list(first.values()) == list(dict.fromkeys(sql for sql, _ in want))


def test_grounding(spark):
    e = spark.createDataFrame([("t", "a", "q1", ["319875432.11", "EMEA", "EMEA"]), ("t", "b", "q2", ["EMEA", "7"]), ("t", "c", "q3", []), ("u", "d", "q1", ["1"])], "trace_id string, span_id string, label string, result_values array<string>")
    a = spark.createDataFrame([("t", "Revenue in EMEA was $319.9M.\n- CITED: q2, q3")], "trace_id string, text string")
    v = {r["span_id"]: r for r in grounding.verify(e, a, ["trace_id"], ["trace_id", "span_id"]).collect()}
    assert set(v) == {"a", "b", "c"} and v["a"]["uniquely_grounded"] and v["a"]["evidence"] == ["319875432.11", "EMEA", "EMEA"]
    assert v["b"]["grounded"] and not v["b"]["uniquely_grounded"] and not v["c"]["grounded"]
    t = {r["trace_id"]: r for r in reports.citations(e, a, ["trace_id"], ["trace_id", "span_id"]).collect()}["t"]
    assert (t["claimed"], t["grounded"], t["unique"], t["claimed_ungrounded"], t["grounded_unclaimed"]) == (2, 2, 1, 1, 1)


def test_grounding_searches_every_text(spark, tmp_path):
    from spanloom.analysis_queries import citation_totals, grounding_flags

    e = [("t", "a", "q1", ["319875432.11", "EMEA"]), ("t", "b", "q2", ["postcard"]), ("t", "c", "q3", ["absent"]), ("u", "d", "q1", ["1234"])]
    spark.createDataFrame([(*x, 1) for x in e], "trace_id string, span_id string, label string, result_values array<string>, logged_at long").write.parquet(str(tmp_path / "agent_events.parquet"))
    texts = [(1, "t", "EMEA made $319.9M.\nCITED: q1"), (2, "t", "A postcard from EMEA.\nCITED: q3"), (3, "t", "Nothing here."), (4, "t", None), (5, "u", "no number")]
    spark.createDataFrame(texts, "doc_id long, trace_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    flags = {r["span_id"]: (r["grounded"], r["uniquely_grounded"], r["evidence"]) for r in grounding_flags(spark, str(tmp_path)).collect()}
    assert flags == {"a": (True, True, ["319875432.11", "EMEA"]), "b": (True, True, ["postcard"]), "c": (False, False, []), "d": (False, False, [])}
    t = {r["trace_id"]: r for r in citation_totals(spark, str(tmp_path)).collect()}
    assert tuple(t["t"])[1:] == (3, 2, 2, 2, 1, 1) and tuple(t["u"])[1:] == (1, 0, 0, 0, 0, 0)


def test_measured_cost_refuses_zeros(spark):
    h = spark.createDataFrame([(1, '{"t":"a"}', 5, 1), (2, '{"t":"a"}', 5, 1), (3, "bad", 5, 1), (4, '{"t":"preflight"}', 1, 1), (5, '{"t":"b"}', 2, None)], "query_id long, query_tag string, total_elapsed_time long, bytes_scanned long")
    none = spark.createDataFrame([(1, 0.0)], "query_id long, credits_attributed_compute double")
    r = reports.measured_cost(h, none).first()
    assert r["traces"] == 2 and r["ratio"] is None and r["reason"]
    r = reports.measured_cost(h, spark.createDataFrame([(1, 0.02), (5, 0.03)], none.schema)).first()
    assert r["cost_per_task"] == pytest.approx(0.075) and r["attributed"] == 2 and r["queries"] == 3
    assert measured.newest(h.withColumn("start_time", F.col("query_id")), 2).count() == 2


def test_trace_report(spark):
    s = spark.createDataFrame([(1, "t", "a", None, "all", 0, 5.0, "x", "x", 1), (2, "t", "b", "A", "EMEA", 10, 5.0, "x", "x", 1), (3, "t", "c", "a", "APAC", 5, 5.0, "y", "x", 1), (4, "t", "c", "a", "APAC", 5, 5.0, "y", "x", 2)],
                              "row_id long, trace_id string, span_id string, parent_span_id string, span_intent string, start_ms long, exec_ms double, exact string, ast string, ingested_at long")
    e = spark.createDataFrame([("t", "b", "q1", "h", 1, 1.0, ["1"], None, True, None, 1), ("t", "b", "q1", "h", 1, 1.0, ["1"], None, False, True, 2)],
                              "trace_id string, span_id string, label string, result_hash string, row_count int, client_ms double, result_values array<string>, error string, used_downstream boolean, grounded boolean, logged_at long")
    r = reports.trace_report(spark, s, e)
    assert [x["span_id"] for x in r["tree"].orderBy("position").collect()] == ["a", "c", "b"]
    assert r["redundancy"].first()["exact_distinct"] == 2 and r["waste"].first()["spans"] == 3 and r["waste"].first()["cited"] == 0
    assert r["bill"].first()["windows"] == 1 and lineage.roots(s).count() == 1
    x = reports.cross_session(spark, spark.createDataFrame([("s1", 1, "select sum(x) from t where d = 1"), ("s2", 2, "select sum(x) from t where d = 2"), ("s2", 3, "not sql")], "session string, at long, sql string")).first()
    assert (x["sessions"], x["modelled"], x["session_anchors"], x["anchors"], x["redundancy"]) == (2, 2, 2, 1, 0.5)


def test_traced_session(spark):
    spark.range(300).createOrReplaceTempView("nums")
    s = client.TracedSession(spark, "agent")
    a = s.run("select id, id * 2 as b from nums order by id", "look")
    b = s.run("drop view nums", "drop", follows_from="q1")
    c = s.run("select missing from nums", "fail", follows_from="q9")
    assert len(a["preview"]) == 50 and a["error"] is None and b["error"] and c["error"]
    assert b["parent_span_id"] == a["span_id"] and b["speculation_class"] == "refine" and c["parent_span_id"] is None
    s.cite(["q1"])
    assert [r["used_downstream"] for r in s.to_df().orderBy("label").collect()] == [True, False, False]
    got = client.pool(spark, [lambda: s.run("select 1 as x", "p")["rows"], lambda: 1 / 0], 2)
    assert got[0] == 1 and isinstance(got[1], ZeroDivisionError)
    assert client.verify_anchors(spark, [("a", "select 1"), ("b", "select nope")]).where("error is null").count() == 1
    assert len(client.scalar_values([{"a": i, "b": "x" * 70, "c": None} for i in range(900)])) == 200


def test_streams(spark, tmp_path):
    rows = [("w", "2026-06-01 00:00:00", 1.0, "f1"), ("w", "2026-06-01 00:00:50", 2.0, "f1"), ("w", "2026-06-01 00:05:00", 1.0, "f2")]
    df = spark.createDataFrame(rows, "w string, ts string, exec_s double, exact string")
    df.write.json(str(tmp_path / "in"))
    schema = "w string, ts timestamp, exec_s double, exact string"
    batch = W.resume_windows(df.withColumn("ts", F.to_timestamp("ts")), "w").orderBy("start").collect()
    assert [(r["spans"], r["billed_s"]) for r in batch] == [(2, 112.0), (1, 61.0)]
    stream = W.read_span_stream(spark, str(tmp_path / "in"), schema)
    q = W.resume_windows(stream, "w").writeStream.outputMode("complete").format("memory").queryName("resumed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert spark.table("resumed").count() == 2
    assert W.redundancy_by_hour(df.withColumn("ts", F.to_timestamp("ts"))).first()["distinct_queries"] == 2


def test_bills_do_not_depend_on_the_pieces(spark):
    """One key with most spans, a null key, ties: the same windows and bills however the spans are cut."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", None]), f"{i}", rng.randrange(0, 4_000_000, 500), rng.choice([None, 0.0, 1500.0, 90_000.0])) for i in range(400)]
    df = spans(spark, rows)
    seen = []
    for parts in ("1", "3", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            w = sorted((str(r["k"]), r["id"], r["window_no"]) for r in B.windows_of(df, ["k"], "id").collect())
            b = sorted((str(r["k"]), r["windows"], r["spans"], *(round(r[c], 6) for c in ("billed_s", "busy_s", "elapsed_s"))) for r in B.bill(df, ["k"], "id").collect())
            a = sorted((str(r["k"]), r["id"], round(r["billed_s"], 6)) for r in B.attribute(df, ["k"], "id").collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        seen.append((w, b, a))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) == 400 and len(seen[0][1]) == 3
    for k in ("a", "b", None):  # the plain sweep
        end, no = None, 0
        for s, i, e in sorted((r[2], r[1], r[2] + (r[3] or 0.0)) for r in rows if r[0] == k):
            no += end is None or s > end + 60_000
            end = e if end is None else max(end, e)
            assert (str(k), i, no) in set(seen[0][0])
