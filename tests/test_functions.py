"""Context, fingerprints, text functions, and statements of the warehouse's log."""

import hashlib

import pytest
from pyspark.sql import functions as F

from spanloom.functions import context as C
from spanloom.functions import fingerprint as FP
from spanloom.functions import text as T
from spanloom.sources import querylog as Q


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("intent", ["plain", "100% of rows", "a*b, c=d", "it's \"x\" /* y */", "café — 日本", "a+b", "  "])
def test_comment_round_trip(spark, intent):
    span = C.Span(C.Trace("agent-1", "m"), intent)
    sql = spark.range(1).select(F.concat(C.comment(span.columns()), F.lit(" select 1")).alias("s")).first()["s"]
    assert "*" not in sql[2:-2].replace("*/ select 1", "")[len("agenttrace:"):].split("*/")[0]
    for strict in (True, False):
        got = one(spark, sql, lambda c: C.parse(c, strict))
        assert (got["span_intent"], got["trace_id"], got["parent_span_id"], got["attempt_n"]) == (intent, span.trace.trace_id, None, 1)
    assert one(spark, sql, C.strip) == "select 1"


def test_parse_edges(spark):
    assert one(spark, "select 1", C.parse) is None
    got = one(spark, "/*agenttrace:t=1,noise,s=2,s=3,p=-,r=9,n=x*/ select 1", C.parse)
    assert (got["trace_id"], got["span_id"], got["parent_span_id"], got["retry_of"], got["attempt_n"]) == ("1", "3", None, "9", None)
    bad = "/*agenttrace:t=1,i=a*b*/ select 1"
    assert one(spark, bad, lambda c: C.parse(c, True)) is None and one(spark, bad, C.parse)["span_intent"] == "a*b"
    assert one(spark, "/*agenttrace:t=1*/  select /*agenttrace:t=2*/ 1", C.strip) == "select /*agenttrace:t=2*/ 1"
    assert one(spark, None, C.parse) is None


def test_tags(spark):
    df = spark.createDataFrame([("t1", "s1", None, "x'); drop \\ \n\t \"y\" " + "z" * 400)], "trace_id string, span_id string, parent_span_id string, span_intent string")
    tag = df.select(C.tag({c: F.col(c) for c in df.columns}).alias("t")).first()["t"]
    got = one(spark, tag, C.parse_tag)
    assert got["trace_id"] == "t1" and got["parent_span_id"] is None and '"p":null' in tag
    assert "'" not in got["span_intent"] and "\\" not in got["span_intent"] and len(got["span_intent"]) <= 300
    assert "''" in C.set_tag_sql("a'b")
    assert one(spark, '{"s":"x"}', C.parse_tag) is None and one(spark, "no json", C.parse_tag) is None
    with pytest.raises(ValueError):
        C.Span(C.Trace("a"), "i", "guess")
    s = C.Span(C.Trace("a"), "i")
    assert s.retry().retry_of == s.span_id and s.retry().attempt_n == 2


def test_normal_form():
    n = FP.normalize
    assert n("SELECT b, a FROM orders o WHERE o.y = 2 AND o.x = 1;") == n("select a,b from orders as q where q.x = 1   and q.y = 2") == "select a, b from orders where orders.x = 1 and orders.y = 2".replace("orders.", "orders.")
    assert n("select a from t where x = 'A'") == n("select a from t where x = 'a'")
    assert n("select a from t where x = 1") != n("select a from t where x = 2")
    assert n("select count(*) from t group by b, a order by 1 limit 2") == "select count(*) from t group by a, b order by 1 limit 2"
    assert n("select a /* c */ from t -- d") == "select a from t"
    assert FP.conjuncts("(a and b) and c AND d") == ["(a and b)", "c", "d"]
    assert n("select a from t where x between 1 and 5 and y = 2") == "select a from t where 5 and x between 1 and y = 2"


def test_hashes(spark):
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()[:12]
    assert one(spark, "  select 1\n ", FP.exact_hash) == sha("select 1")
    assert one(spark, "SELECT 1;", FP.normalized_hash) == sha("select 1")
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    a = df.agg(FP.unordered_result_hash(df)).first()[0]
    assert a == df.orderBy(F.desc("id")).repartition(3).agg(FP.unordered_result_hash(df)).first()[0] != df.limit(49).agg(FP.unordered_result_hash(df)).first()[0]
    assert FP.result_hash([{"a": 1}]) != FP.result_hash([{"a": 2}])
    spark.range(3).createOrReplaceTempView("tiny")
    assert FP.semantic_hash(spark, "select id from tiny where id > 1 and id < 9") == FP.semantic_hash(spark, "select id from tiny where id > 1 and id < 9")


@pytest.mark.parametrize("text,want", [("$319.9M and 2.16M", [319.9, 319.9e6, 2.16, 2.16e6]), ("1,234.5 or -1.25%", [1234.5, -1.25]), ("2026-07-12", [2026, -7, -12]), ("60s", []), ("3bn, 4 k", [3, 3e9, 4, 4000]), ("none", [])])
def test_numbers(spark, text, want):
    assert one(spark, text, T.numbers) == pytest.approx(want)


def test_presence_citations_labels(spark):
    df = spark.createDataFrame([("in july 12 we saw emea", [150.0, 319.9e6])], "t string, n array<double>")
    f = lambda e: df.select(e.alias("y")).first()["y"]
    assert f(T.text_present(F.lit("2026-07-12"), F.col("t"))) and f(T.text_present(F.lit("EMEA"), F.col("t"))) and not f(T.text_present(F.lit("in"), F.col("t")))
    assert f(T.number_present(F.lit(149.87), F.col("n"))) and f(T.number_present(F.lit(319875432.11), F.col("n"))) and not f(T.number_present(F.lit(160.0), F.col("n")))
    assert one(spark, "text\n**CITED: q1, Q4**\nmore", T.cited) == ["q1", "q4"] and one(spark, "> - CITED: q2 q2.", T.cited) == ["q2"] and one(spark, "no line", T.cited) is None
    assert one(spark, "EMEA paid_search on 2026-07-12", T.intent_label) == "<region> <channel> on <date>"
    assert [one(spark, x, T.as_number) for x in ("12", " -1.50 ", "1e3", "x")] == [12.0, -1.5, None, None]


P, D = "2026-06-02 08:33:0{}.000 UTC [{}] LOG:  statement: {}", "2026-06-02 08:33:0{}.500 UTC [{}] LOG:  duration: {} ms"


def log(spark, *lines):
    return spark.createDataFrame([("l", i, x) for i, x in enumerate(lines, 1)], "log_id string, line_no long, line string")


def test_pairing_modes(spark):
    df = log(spark, "lost tail", P.format(1, 10, "select a"), "\tfrom t", P.format(2, 20, "select b"), D.format(3, 10, "5.5"), "stray", D.format(4, 20, "7"), D.format(5, 20, "9"))
    def got(mode):
        return {r["line_no"]: (r["sql"], r["duration_ms"]) for r in Q.statements(df, mode).collect()}
    assert got("slot") == {2: ("select a\n\tfrom t", None), 4: ("select b", 7.0)}
    assert got("per_pid") == {2: ("select a\n\tfrom t", 5.5), 4: ("select b", 7.0)}
    with pytest.raises(ValueError):
        Q.statements(df, "other")


def test_spans_of_a_log(spark, tmp_path):
    tag = "/*agenttrace:t=T1,s=S1,p=-,a=ag,c=probe,n=1,r=-,i=look%20up*/ "
    text = "\n".join([P.format(1, 10, tag + "select 1"), D.format(2, 10, "12.5"), P.format(3, 10, "select untagged"), P.format(4, 10, tag.replace("S1", "S2") + "select 2")])
    (tmp_path / "a.log").write_text(text)
    got = {r["span_id"]: r for r in Q.spans(Q.statements(Q.read_lines(spark, str(tmp_path / "a.log")))).collect()}
    assert set(got) == {"S1", "S2"} and got["S1"]["exec_ms"] == 12.5 and got["S2"]["exec_ms"] == 0.0
    assert got["S1"]["sql_text"] == "select 1" and got["S1"]["parent_span_id"] is None and got["S1"]["span_intent"] == "look up"


def test_events_and_answers(spark, tmp_path):
    e = spark.createDataFrame([("t", "s", ["1", "x"])], "trace_id string, span_id string, values array<string>")
    Q.write_events(e, str(tmp_path / "ev"))
    back = Q.read_events(spark, [str(tmp_path / "ev"), str(tmp_path / "missing")])
    assert back.first()["values"] == ["1", "x"] and Q.read_events(spark, [str(tmp_path / "missing")]).count() == 0
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        Q.read_events(spark, [str(tmp_path / "bad.jsonl")]).collect()
    (tmp_path / "answer.txt").write_text("a\nb")
    assert Q.read_answer(spark, str(tmp_path / "answer.txt")).first()["text"] == "a\nb"


def test_generated_tables(spark):
    o = Q.warehouse_orders(spark, per_cell=5)
    assert o.count() == 61 * 12 * 5 and o.select("order_id").distinct().count() == o.count()
    assert 0 < Q.warehouse_refunds(o, 0.1).count() < o.count() * 0.2 and Q.decoy(spark, 3).count() == 200


def test_pieces_of_a_log_hand_on_what_is_pending(spark):
    import random

    rng = random.Random(6)
    lines = []
    for i in range(240):
        t, pid = i % 10, rng.choice((10, 20))
        lines.append(rng.choice([P.format(t, pid, f"select {i}"), D.format(t, pid, f"{i}.5"), "\tmore", "", f"2026-06-02 08:33:0{t}.000 UTC [{pid}] ERROR:  x"]))
    df = log(spark, *lines).unionByName(log(spark, *lines[:50]).withColumn("log_id", F.lit("m")))
    seen = {}
    for parts in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            for mode in ("slot", "per_pid"):
                got = sorted(map(tuple, Q.statements(df, mode).collect()))
                assert seen.setdefault(mode, got) == got
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(seen["slot"]) > 30 and seen["slot"] != seen["per_pid"] and any(r[5] for r in seen["slot"])


def test_large_files_are_read_in_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(900)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    (tmp_path / "b.log").write_text("one\ntwo")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = Q.read_lines(spark, str(tmp_path / "a.log"), str(tmp_path / "b.log"))
        assert df.rdd.getNumPartitions() > 5
        rows = df.orderBy("log_id", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["line"] for r in rows] == [*lines, "one", "two"] and len({(r["log_id"], r["line_no"]) for r in rows}) == 902
    assert [r["line_no"] for r in rows if r["log_id"].endswith("b.log")] == [1, 2]
