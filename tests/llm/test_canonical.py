"""Canonical statements and their groups."""

import random

import pytest

from spanloom.llm import canonical as C

BASE = "SELECT region, SUM(CASE WHEN a = 'x' AND b > 1 THEN c ELSE 0 END) AS s FROM t WHERE day BETWEEN 1 AND 5 AND region = 'EMEA' AND (k < 3) GROUP BY region, DATE_TRUNC('day', d) ORDER BY region DESC, s LIMIT 5"
SAME = [
    BASE.lower() + " ;", BASE.replace(" ", "  "), BASE.replace(" ", "\n\t"), BASE.replace(" ", " "), BASE.replace("'", "’").replace("= ’", "= ‘"), BASE + "；",
    BASE.replace("region, SUM(CASE WHEN a = 'x' AND b > 1 THEN c ELSE 0 END) AS s FROM", "SUM( CASE WHEN a='x' AND b>1 THEN c ELSE 0 END ) AS s ,region FROM"),
    BASE.replace("day BETWEEN 1 AND 5 AND region = 'EMEA' AND (k < 3)", "k<3 AND (region = 'emea') AND day BETWEEN 1 AND 5"),
    BASE.replace("day BETWEEN 1 AND 5 AND region = 'EMEA' AND (k < 3)", "((day BETWEEN 1 AND 5 AND region = 'EMEA') AND k < 3)"),
    BASE.replace("GROUP BY region, DATE_TRUNC('day', d)", 'GROUP BY DATE_TRUNC (\'day\' ,d), "region"'), "/* note */ " + BASE + " -- end",
]
OTHER = [
    BASE.replace("k < 3", "k <= 3"), BASE.replace("LIMIT 5", "LIMIT 50"), BASE.replace("AS s", "AS s2"), BASE.replace("region DESC, s", "s, region DESC"), BASE.replace("BETWEEN 1 AND 5", "BETWEEN 5 AND 1"),
    BASE.replace("b > 1", "b > 10"), BASE.replace("'EMEA'", "'APAC'"), BASE.replace("a = 'x' AND b > 1", "b > 1 AND a = 'x'"), BASE.replace(" ORDER BY region DESC, s", ""), BASE.replace("SELECT", "SELECT DISTINCT"),
]


@pytest.mark.parametrize("sql", SAME)
def test_equal_forms(sql):
    assert C.canonical(sql) == C.canonical(BASE)


@pytest.mark.parametrize("sql", OTHER)
def test_different_forms(sql):
    assert C.canonical(sql) != C.canonical(BASE)


def test_minus_is_ordered_and_positions_name_items():
    assert C.canonical("select sum(a - b) from t") != C.canonical("select sum(b - a) from t")
    assert C.canonical("select a, count(*) from t group by 1") == C.canonical("select count(*), a from t group by 2")
    assert C.canonical("select a from t where x = 1 or y = 2 and z = 3") != C.canonical("select a from t where x = 1 and y = 2 or z = 3")


def test_groups_over_partitions_with_a_hot_form(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(SAME) if rng.random() < 0.5 else None if rng.random() < 0.1 else f"select {rng.randrange(30)}{' ' * rng.randrange(3)}", "f", 1) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, sql_text string, form string, part int").repartition(5)
    want = {}
    for i, s, *_ in rows:
        if s is not None:
            want.setdefault(C.canonical(s), []).append(i)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C.runs(df)
        assert {(r["first_row_id"], r["row_id"]) for r in got.collect()} == {(min(v), x) for v in want.values() for x in v}
        reps = {r["first_row_id"]: r["copies"] for r in C.representatives(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert reps == {min(v): len(v) for v in want.values()}


def test_empty_blank_and_long(spark):
    df = spark.createDataFrame([(1, ""), (2, "  "), (3, None), (4, "select " + "a, " * 5000 + "b"), (5, "SELECT b" + " , a" * 5000)], "row_id long, sql_text string")
    assert {(r["first_row_id"], r["row_id"]) for r in C.runs(df).collect()} == {(1, 1), (1, 2), (4, 4), (4, 5)}
    assert C.runs(df.limit(0)).count() == 0


def test_opened_comments_and_quotes_end_in_time():
    assert C.canonical("select a /* b") == C.canonical("select a / * b")
    assert C.canonical("/* " * 50_000).count("*") == 50_000
    assert C.canonical("select '" + "x" * 100_000)
