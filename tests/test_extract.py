"""The executors' shape reader against the parser's plan."""

import pytest

from spanloom.plans import extract as X
from spanloom.plans.sqlplan import Declined, Shape, try_shape

STATEMENTS = [
    "select date_trunc('day', d) as day, sum(a) from t where x = 'A' and y between 1 and 5 and z <> 3 group by 1", "select avg(a), count(*) from t o where (o.x in ('a','b')) and (p = 1 and q = -2) group by o.x",
    "select sum(a)/count(*) r, count(*) from t", "select a, sum((b+c)*d) from t where not (a = 1 and b is null) group by a order by 2 desc limit 5", "select count(*) from t where (a = 1 or b = 2)",
    "select count(*) from t where (a) = 1 and (a + b) * 2 > 3", "select sum(a), b c from t group by c", "select count(1) from a.b", "select max(a) + 1 from t", "select count(*) from t where x not in (1,2) and y not between 1 and 2 and z is not null",
    "select * from t", "select a from t", "select count(*) from a join b on a.x = b.x", "select count(*) from a, b", "with c as (select 1) select count(*) from c", "select a, count(*) from t group by a having count(*) > 1", "nonsense",
    "select sum(a) over () from t", "select count(*) from t where a in (select 1)", "select count(*) from (select 1)", "select count(*) from t; select 1", "select distinct count(*) from t", "select count(*) filter (where a > 1) from t",
    "select count(*) from t union all select 1", "select sum(case when a = 1 then 2 else 3 end) from t", "select count(distinct a), min(b - 1.50) from t where c = 'it''s' -- x", "select d::date, count(*) from t group by d::date", "select round(avg(a), 2) from t",
    "select count(*) from t where 1 = a", "select b, count(*) from t", "select count(*), a from t group by 1",
]


@pytest.mark.parametrize("sql", STATEMENTS)
def test_equals_the_plan(spark, sql):
    try:
        mine: Shape | None = X.shape_of(sql)
    except Declined:
        mine = None
    assert mine == try_shape(spark, sql)[0]


def test_tables(spark):
    df = spark.createDataFrame([(1, "select count(*) from t"), (2, None), (3, ""), (4, 'select "A", count(*) from "T" group by "A";'), (5, "select count(*) from t where " + " and ".join(f"a{i} = {i}" for i in range(800)))], "row_id long, q string")
    got = {r["shape_id"]: r for r in X.shapes(df, "q", "row_id").collect()}
    assert got[1]["measures"] == ["count(*)"] and got[2]["reason"] == got[3]["reason"] == "empty statement" and got[4]["groupby"] == ["a"] and len(got[5]["filters"]) == 800
    assert X.shapes(df.limit(0), "q", "row_id").count() == 0
