"""The registered queries of the core: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import hierarchy as H
from spanloom.operators import logparse, skew
from spanloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with the SQL that must give the same rows."""
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f
    return add


# --- problem 1: parent-child links to full hierarchies -------------------------------------------------------------

#: SQL of the nodes, their links, and every (node, node met when the links are followed up).
_NODES = """
clean as (select nullif(nullif(lower(regexp_replace(trace_id, '^\\s+|\\s+$', '', 'g')), ''), '-') as g, nullif(nullif(lower(regexp_replace(span_id, '^\\s+|\\s+$', '', 'g')), ''), '-') as k,
                 nullif(nullif(lower(regexp_replace(parent_span_id, '^\\s+|\\s+$', '', 'g')), ''), '-') as p, span_id, row_id, ingested_at from spans),
latest as (select g, k, p from clean where g is not null and k is not null qualify row_number() over (partition by g, k order by ingested_at desc nulls last, row_id desc) = 1),
names as (select g, k, arg_min(span_id, row_id) as shown from clean where g is not null and k is not null group by 1, 2),
links as (select a.g, a.k, b.k as p, n.shown from latest a join names n on n.g = a.g and n.k = a.k left join latest b on b.g = a.g and b.k = a.p),
walk as (select g, k, p as met from links where p is not null union select w.g, w.k, l.p from walk w join links l on l.g = w.g and l.k = w.met where l.p is not null and w.met <> w.k)"""


@query(f"with recursive {_NODES} select w.g as trace_id, n.shown as span_id from walk w join names n on n.g = w.g and n.k = w.k where w.met = w.k")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Spans on a ring of parent links."""
    return H.hierarchy(table(spark, d, "spans")).where("status = 'cycle'").select("trace_id", "span_id")


@query()
def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(table(spark, d, "spans"))


@query(f"""
with recursive {_NODES},
tree as (select g, k, shown, null::varchar as up, shown as root, 0 as depth, shown as path from links where p is null
         union all select l.g, l.k, l.shown, t.shown, t.root, t.depth + 1, t.path || '/' || l.shown from tree t join links l on l.g = t.g and l.p = t.k),
ring as (select distinct g, k from walk where met = k),
below as (select g, met as k, count(*) as n from walk where met <> k group by 1, 2)
select l.g as trace_id, l.shown as span_id, u.shown as parent_id, case when t.k is not null then 'tree' when r.k is not null then 'cycle' else 'leads_to_cycle' end as status,
       t.root as root_id, t.depth, t.path as path_text, case when r.k is null then 1 + coalesce(b.n, 0) end as subtree_size
from links l left join names u on u.g = l.g and u.k = l.p left join tree t on t.g = l.g and t.k = l.k left join ring r on r.g = l.g and r.k = l.k left join below b on b.g = l.g and b.k = l.k""")
def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy with its paths as text."""
    return H.hierarchy(table(spark, d, "spans")).withColumn("path_text", F.array_join("path", "/")).drop("path")


@query(f"""
with recursive {_NODES}
select w.g as trace_id, a.shown as ancestor_id, count(*) as descendants from walk w join names a on a.g = w.g and a.k = w.met where w.met <> w.k group by 1, 2""")
def p1_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many descendants each span has, counted from the pairs."""
    return H.descendants_of(table(spark, d, "spans")).groupBy("trace_id", "ancestor_id").agg(F.count(F.lit(1)).alias("descendants"))


@query()
def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants_of(table(spark, d, "spans"))


# --- problem 3: log lines into fields ------------------------------------------------------------------------------

@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last line of every record of severity error or worse."""
    return logparse.entries(table(spark, d, "query_log")).where(F.col("level").isin(*logparse.SEVERE)).select("log_id", "first_line", "last_line")


@query()
def p3_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every record; lines that belong to none come as rows without layout and level."""
    return logparse.entries(table(spark, d, "query_log"), unknown=True)


# --- problem 5: a few keys hold most rows --------------------------------------------------------------------------

@query("select instance_id from r group by instance_id having count(*) * 100 >= (select count(*) from r) and instance_id is not null")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Instances with at least 1 % of all rows."""
    per = skew.per_key(table(spark, d, "r"), "instance_id", "feature_fingerprint")
    return per.where("queries * 100 >= total and instance_id is not null").select("instance_id")


@query("""
select instance_id, count(*) as queries, count(distinct feature_fingerprint) as distinct_items,
       1 - count(distinct feature_fingerprint) / nullif(count(feature_fingerprint), 0)::double as redundancy
from r group by instance_id""")
def p5_instances(spark: SparkSession, d: str) -> DataFrame:
    return skew.per_key(table(spark, d, "r"), "instance_id", "feature_fingerprint").drop("total")


@query("""
with base as (select instance_id, avg(exec_ms) as mean_ms from r group by instance_id)
select r.instance_id, count(*) as queries, count(case when r.exec_ms > 2 * base.mean_ms then 1 end) as slow
from r join base on r.instance_id = base.instance_id group by r.instance_id""")
def p5_slow_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries slower than twice their instance's mean: every row meets its instance's row, without skew."""
    r = table(spark, d, "r").select("instance_id", "query_id", "exec_ms")
    base = r.groupBy("instance_id").agg(F.avg("exec_ms").alias("mean_ms"))
    joined = skew.fragment_replicate_join(r, base, "instance_id", "query_id")
    return joined.groupBy("instance_id").agg(F.count(F.lit(1)).alias("queries"), F.count(F.when(F.col("exec_ms") > 2 * F.col("mean_ms"), 1)).alias("slow"))
