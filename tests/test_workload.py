"""The demonstration workload end to end, sinks, catalog, environment files."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom import reports, workload
from spanloom.functions import fingerprint as FP
from spanloom.plans import rollup
from spanloom.sources import querylog, sinks


def test_workload(spark):
    rows = workload.statements()
    assert len(rows) == 93 and len({r[3] for r in rows}) == 7 and sum(r[-1] for r in rows) == 4
    labels = {r[1] for r in rows}
    assert all(r[2] is None or r[2] in labels for r in rows) and workload.workload(spark).count() == 93
    shapes, declined = reports.shapes_of(spark, [(r[0], r[6]) for r in rows], "strict")
    s = reports.cover_summary(spark, shapes, len(rows)).first()
    assert declined.count() == 0 and s["modelled"] == 93 and s["covered"] == 93 and s["anchors"] <= 4
    chosen = rollup.cover(rollup.frame(spark, shapes))
    by_id = dict(shapes)
    orders = querylog.warehouse_orders(spark, per_cell=3)
    orders.createOrReplaceTempView("orders")
    anchor, _, got = next(x for x in chosen if x[0].table == "orders")
    built = rollup.build(orders, anchor).cache()
    for i in got[:: max(1, len(got) // 6)]:
        q = by_id[i]
        cols = [*q.groupby, *q.measures]
        want = sorted(tuple(map(str, r)) for r in spark.sql(q.sql()).collect())
        have = sorted(tuple(map(str, r)) for r in rollup.answer(built, anchor, q).select(*[f"`{c}`" for c in cols]).collect())
        if not any(m.startswith("avg") for m in q.measures):
            assert have == want, q


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    sinks.write_summary(df.limit(1), str(tmp_path / "s"))
    assert json.loads(next((tmp_path / "s").glob("*.json")).read_text())["id"] == 0
    with pytest.raises(ValueError):
        sinks.write_verified(df, str(tmp_path / "x"), str(tmp_path / "." / "x"))
    sinks.write_verified(df, str(tmp_path / "y"), str(tmp_path / "x"))
    df.createOrReplaceTempView("three")
    assert sinks.catalog_tables(spark).where("table_name = 'three'").count() == 1
    assert sinks.catalog_columns(spark).where("table_name = 'three' and column_name = 'id'").first()["data_type"] == "bigint"


def test_env(tmp_path):
    (tmp_path / ".env").write_text("A=1\nexport B='x y'\n# C=3\nnoise\nD=\"q\"\n")
    assert sinks.load_env(str(tmp_path / ".env"), {"A": "kept"}) == {"A": "kept", "B": "x y", "D": "q"}
    assert sinks.load_env(str(tmp_path / "missing"), {}) == {}


def test_retries_differ_in_text_only(spark):
    w = workload.workload(spark)
    r = w.where("phase = 'amounts'").select("label", "retry_of", "attempt_n", F.split("span_intent", " of ")[1].alias("c"), FP.exact_hash(F.col("sql")).alias("exact"), FP.normalized_hash(F.col("sql")).alias("ast")).collect()
    # the first attempt names its columns without the table, the retries with an alias: their normal forms meet
    assert len(r) == 12 and len({x["exact"] for x in r}) == 12 and len({x["ast"] for x in r}) == 8 == len({(x["c"], x["ast"]) for x in r})
    by = {x["label"]: x for x in r}
    assert all((x["retry_of"] is None) == (x["attempt_n"] == 1) for x in r) and all(by[x["retry_of"]]["attempt_n"] == x["attempt_n"] - 1 and (by[x["retry_of"]]["ast"] == x["ast"]) == (x["attempt_n"] == 3) for x in r if x["retry_of"])


def test_single_trace_report_with_advice(spark):
    """The workload run as one traced task over a small warehouse: report, advice, text, score."""
    from spanloom import client, reports
    from spanloom.sources import querylog as Q

    o = Q.warehouse_orders(spark, per_cell=1)
    o.createOrReplaceTempView("orders")
    Q.warehouse_refunds(o, 0.2).createOrReplaceTempView("refunds")
    steps = [s for s in workload.statements() if s[3] in ("overview", "regions", "amounts", "refunds", "final")]
    s = client.TracedSession(spark, "agent")
    known: dict = {}
    for _, label, follows, _, _, intent, sql, _, retry, _ in steps:
        known[label] = s.run(sql, intent, known[follows]["label"] if follows in known else None, retry_of=known.get(retry))
    s.cite([known[x[1]]["label"] for x in steps if x[-1]])
    rows = [(i, e["trace_id"], e["span_id"].upper(), e["parent_span_id"], e["span_intent"], 1000 * i, 500.0, x[6], 1) for i, (e, x) in enumerate(zip(s.events, steps))]
    spans = spark.createDataFrame(rows, "row_id long, trace_id string, span_id string, parent_span_id string, span_intent string, start_ms long, exec_ms double, sql_text string, ingested_at long").withColumns({"exact": FP.exact_hash(F.col("sql_text")), "ast": FP.normalized_hash(F.col("sql_text"))})
    events = s.to_df().select("trace_id", "span_id", "label", "result_hash", F.col("rows").alias("row_count"), "client_ms", F.col("values").alias("result_values"), "error", "used_downstream", "grounded", F.lit(1).alias("logged_at"))
    trace = s.trace.trace_id
    parts = reports.single_trace(spark, spans, events, trace)
    advice = {r["action"]: r for r in parts["advice"].collect()}
    bill = parts["bill"].first()
    assert set(advice) == {"batch", "materialize", "drop"} and abs(advice["batch"]["dollars_now"] - bill["dollars"]) < 1e-9 and advice["batch"]["gain"] >= 1
    assert 0 <= advice["materialize"]["gain"] <= 1 and parts["verified"].where("error is null").count() == parts["verified"].count() > 0
    assert (reports.compute_saved(926.0, 9.426) - 0.902) < 1e-3 and reports.compute_saved(1.0, 0.0) == 0
    text = reports.lines(parts, trace)
    assert text[0].endswith(f"{len(steps)} statements") and "advice" in text and any("rollups" in x for x in text)
    answer = spark.createDataFrame([(trace, "CITED: q1")], "trace_id string, text string")
    got = reports.score(events, answer, ["trace_id"], ["trace_id", "span_id"]).first()
    assert got["statements"] == len(steps) and got["failed"] == 0 and got["claimed"] == 1
    assert len(Q.decoys(spark, 3, 5)) == 3 and spark.table("decoy_002").count() == 5
    for v in ("orders", "refunds", "decoy_001", "decoy_002", "decoy_003"):
        spark.catalog.dropTempView(v)


def test_sessions_of_each_rollup(spark, tmp_path):
    from spanloom.analysis_queries import anchor_sessions

    rows = [(i, f"t{i % 3}", f"s{i}", f"select sum(x) from t where d = {i % 7}", 1) for i in range(30)] + [(90, "t9", "a", "select max(y) from u where k > 2", 1), (91, "t9", "b", "no", 1)]
    spark.createDataFrame(rows, "row_id long, trace_id string, span_id string, sql_text string, ingested_at long").write.parquet(str(tmp_path / "spans.parquet"))
    got = sorted((r["statements"], r["sessions"]) for r in anchor_sessions(spark, str(tmp_path)).collect())
    assert got == [(1, 1), (30, 3)]
