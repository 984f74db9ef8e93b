"""Records of every layout, continuations, edges and the defined cases."""

from datetime import datetime

import pytest

from spanloom.operators import logparse as L

CASES = [
    ("2026-06-02 08:33:00.037 UTC [4888] LOG:  preview", "log", "preview", datetime(2026, 6, 2, 8, 33, 0, 37000)),
    ("2026-07-04 00:04:41 PDT [2404]: user=a,db=b,app=x y ERROR:  boom:  twice", "error", "boom:  twice", datetime(2026, 7, 4, 7, 4, 41)),
    ("1783252173.787 [2730-25] batch@shop PANIC:  gone", "panic", "gone", datetime(2026, 7, 5, 11, 49, 33, 787000)),
    ("<2026-06-21 17:16:43.794 CEST 6a38005b.1393 42P01> DETAIL:  Key", "detail", "Key", datetime(2026, 6, 21, 15, 16, 43, 794000)),
    ('2026-06-16 17:49:49.194 UTC,"loader","depot",5058,"1",FATAL,00000,"no ""x"" left",,"runner"', "fatal", 'no "x" left', datetime(2026, 6, 16, 17, 49, 49, 194000)),
    ("2026-06-15 02:21:08.926 UTC [90] ERROR C-0x1de07167d3c: depot/b@unix:6432 lost", "error", "depot/b@unix:6432 lost", datetime(2026, 6, 15, 2, 21, 8, 926000)),
    ('{"level": 50, "msg": "a\\nb", "last": {"level": "info"}, "time": 1783378496666}', "error", "a\nb", datetime(2026, 7, 6, 22, 54, 56, 666000)),
    ('{"last": {"level": "error"}, "level": "WARN", "msg": "m", "ts": "2026-07-06T22:54:43.970Z"}', "warning", "m", datetime(2026, 7, 6, 22, 54, 43, 970000)),
    ("2026-07-01 17:23:37,236 - trace.assemble - CRITICAL - lost", "critical", "lost", datetime(2026, 7, 1, 17, 23, 37, 236000)),
    ('ts=2026-07-01T19:17:35.741Z level=err span=1 component=g msg="say \\"no\\""', "error", 'say "no"', datetime(2026, 7, 1, 19, 17, 35, 741000)),
    ("<163>1 2026-07-25T04:49:17.953Z node6 pool 739 - - context", "error", "context", datetime(2026, 7, 25, 4, 49, 17, 953000)),
    ("<8>1 2026-07-25T04:49:17.953Z node6 pool 739 - - down", "emergency", "down", datetime(2026, 7, 25, 4, 49, 17, 953000)),
    ("[13/Jun/2026:08:19:59 +0200] (E) assemble: invalid", "error", "invalid", datetime(2026, 6, 13, 6, 19, 59)),
]


@pytest.mark.parametrize("line,level,message,ts", CASES)
def test_layouts(line, level, message, ts):
    at = L.begin(line)
    assert at is not None
    when, lvl, _, text = L.fields(*at, [line])
    assert (lvl, text, when) == (level, message, ts)


@pytest.mark.parametrize("line", ["", "ERROR:  column not in group by", "\t2026-06-14 11:05", "level=error lines seen so far: 9", "} expected", '  "level": "error",', "2026-07-03 | 34.50", "-- ERROR rows", "FATAL counter reset", "{not json", "{}"])
def test_continuations(line):
    assert L.begin(line) is None


def rows(spark, logs):
    return spark.createDataFrame([(g, i, x, "c", 1) for g, xs in logs.items() for i, x in enumerate(xs, 1)], "log_id string, line_no long, line string, kind string, raw int")


def test_records_over_lines_and_piece_edges(spark):
    a, b = CASES[0][0], CASES[4][0]
    logs = {"x": ["tail of something", "ERROR:  more of it", a, "\tcont", "", "{", '  "level": "fatal",', '  "msg": "m"', "}", b.replace('left"', "left"), 'WARNING: cut",,"r"'], "y": [], "z": ["only a tail"]}
    logs["big"] = [a] + ["\tmore"] * 400 + [a]
    df = rows(spark, logs)
    want = {("x", 3, 5, "log"), ("x", 6, 9, "fatal"), ("x", 10, 11, "fatal"), ("big", 1, 401, "log"), ("big", 402, 402, "log")}
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = L.entries(df.unionByName(df.where("line_no % 3 = 0")).orderBy("line")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert {(r["log_id"], r["first_line"], r["last_line"], r["level"]) for r in got} == want
        assert len(got) == len(want)
        assert next(r for r in got if r["first_line"] == 1)["message"].count("more") == 400


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1, "x"), ("a", None, "x"), ("a", 1, None), ("a", 2, CASES[0][0])], "log_id string, line_no long, line string")
    assert [(r["first_line"], r["last_line"]) for r in L.entries(df).collect()] == [(2, 2)]
    assert L.entries(df.limit(0)).count() == 0


def test_prefix_is_compiled_from_the_setting():
    states = L.compile_prefix("%m [%p] %u@%d ")
    got = L.run(states, "2026-06-02 08:33:00.037 UTC [48] me@db ERROR:  x")
    assert (got["pid"], got["user"], got["db"], got["level"], got["message"]) == ("48", "me", "db", "ERROR", "x")


def pieces(spark, df, parts, **k):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return sorted(tuple(r) for r in L.entries(df, **k).drop("ts").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


CSV = '2026-07-05 04:12:00.532 UTC,"loader","ledger",6934,"85",ERROR,00000,"canceled'
FAKE = "2026-07-05 04:11:56.532 UTC [4121] LOG:  statement: select 1"


def test_quoted_cells_hold_lines_that_look_like_records(spark):
    end = FAKE + '",,"runner"'
    logs = {"a": [CSV, "excerpt", FAKE, FAKE, end, CASES[0][0], "more", CSV + '",,"r"', FAKE, CSV, FAKE, CSV, FAKE, end, FAKE, "tail"], "b": [FAKE, CSV, *[FAKE] * 40, end, FAKE, CSV, *["x"] * 9], "c": ["lost", FAKE], "d": ["nothing", "known"]}
    df = rows(spark, logs)
    whole = pieces(spark, df, 1)
    spans = {(r[0], r[1], r[2], r[3]) for r in whole}
    assert {x for x in spans if x[0] == "a"} == {("a", 1, 5, "error"), ("a", 6, 7, "log"), ("a", 8, 8, "error"), ("a", 9, 9, "log"), ("a", 10, 11, "error"), ("a", 12, 14, "error"), ("a", 15, 16, "log")}
    assert {x for x in spans if x[0] != "a"} == {("b", 1, 1, "log"), ("b", 2, 43, "error"), ("b", 44, 44, "log"), ("b", 45, 54, "error"), ("c", 2, 2, "log")}
    for parts in (2, 5, 9, 23, 60):
        assert pieces(spark, df, parts) == whole
    lost = [r for r in pieces(spark, df, 1, unknown=True) if r[3] is None]
    assert [(r[0], r[1], r[2], r[5]) for r in lost] == [("c", 1, 1, "lost"), ("d", 1, 2, "nothing\nknown")]
    covered = sorted((r[0], i) for r in pieces(spark, df, 9, unknown=True) for i in range(r[1], r[2] + 1))
    assert covered == sorted((g, i) for g, xs in logs.items() for i in range(1, len(xs) + 1))


def test_prefixes_of_the_caller(spark):
    prefixes = ["%m [%p] %q%u@%d/%i ", "%-6u|%b|%x %s "]
    lines = ["2026-06-02 08:33:00.037 UTC [48] me@db/SELECT ERROR:  x", "2026-06-02 08:33:00.037 UTC [48] FATAL:  y", "bob   |client backend|771 2026-06-02 08:33:00 UTC PANIC:  z", "other"]
    got = L.entries(rows(spark, {"l": lines}), prefixes=prefixes).orderBy("first_line").collect()
    assert [(r["level"], r["message"], r["last_line"]) for r in got] == [("error", "x", 1), ("fatal", "y", 2), ("panic", "z\nother", 4)]
