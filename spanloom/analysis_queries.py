"""Registered queries of the analytics operators, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom import reports
from spanloom.functions import context, fingerprint
from spanloom.functions import text as T
from spanloom.operators import billing, fleet, grounding, lineage, measured
from spanloom.plans import extract, rollup
from spanloom.plans.sqlplan import Shape, refusal
from spanloom.queries import query
from spanloom.session import cut, shared_folder, ship, table
from spanloom.sources import querylog
from spanloom.streaming import windows as streams

# pieces of SQL that several oracles share
_SPANS = """
latest as (
  select lower(trim(trace_id)) as trace_key, lower(trim(span_id)) as span_key, * from spans
  qualify row_number() over (partition by lower(trim(trace_id)), lower(trim(span_id)) order by ingested_at desc nulls last, row_id desc) = 1)"""
_EVENTS = """
latest_e as (
  select lower(trim(trace_id)) as trace_key, lower(trim(span_id)) as span_key, label, result_hash, row_count, client_ms, result_values, error, used_downstream, grounded from agent_events
  qualify row_number() over (partition by lower(trim(trace_id)), lower(trim(span_id)) order by logged_at desc nulls last, label desc nulls last, result_hash desc nulls last) = 1)"""
_PARENT = "nullif(nullif(lower(trim(parent_span_id)), ''), '-')"


# --- fleet redundancy -------------------------------------------------------------------------------------------------

_FLEET = """
select instance_id, count(*) as queries, count(distinct feature_fingerprint) as distinct_queries, 1 - count(distinct feature_fingerprint) / count(*)::double as redundancy
from r where lower(query_type) = 'select' and feature_fingerprint is not null group by instance_id having count(*) >= 100"""


@query(_FLEET)
def fleet_redundancy(spark: SparkSession, d: str) -> DataFrame:
    return fleet.redundancy(fleet.selects(table(spark, d, "r")))


@query(f"""
select count(*) as clusters, round(100 * median(redundancy), 1) as median_pct, round(100 * quantile_disc(redundancy, 0.25), 1) as p25_pct, round(100 * quantile_disc(redundancy, 0.75), 1) as p75_pct,
       round(100 * min(redundancy), 1) as min_pct, round(100 * max(redundancy), 1) as max_pct, round(100 * avg(case when redundancy >= 0.8 then 1.0 else 0.0 end), 1) as high_pct from ({_FLEET})""")
def fleet_summary(spark: SparkSession, d: str) -> DataFrame:
    return fleet.summary(fleet.redundancy(fleet.selects(table(spark, d, "r"))))


@query(f"""
with {_SPANS}
select trace_key, count(exact) as exact_total, count(distinct exact) as exact_distinct, case when count(exact) > 0 then count(distinct exact) / count(exact)::double else 1.0 end as exact_ratio,
       count(ast) as ast_total, count(distinct ast) as ast_distinct, case when count(ast) > 0 then count(distinct ast) / count(ast)::double else 1.0 end as ast_ratio
from latest group by trace_key""")
def whole_query_ratio(spark: SparkSession, d: str) -> DataFrame:
    return fleet.distinct_ratio(lineage.latest_spans(table(spark, d, "spans")), ["exact", "ast"], "trace_key")


@query("select l_returnflag || '/' || l_linestatus as kind, count(*) as total, count(distinct l_suppkey) as distinct_keys, count(distinct l_suppkey) / count(*)::double as ratio from lineitem group by 1")
def distinct_ratio_by_kind(spark: SparkSession, d: str) -> DataFrame:
    x = fleet.distinct_ratio(table(spark, d, "lineitem").withColumn("kind", F.concat("l_returnflag", F.lit("/"), "l_linestatus")), ["l_suppkey"], "kind")
    return x.select("kind", F.col("l_suppkey_total").alias("total"), F.col("l_suppkey_distinct").alias("distinct_keys"), F.col("l_suppkey_ratio").alias("ratio"))


# --- fingerprints and context -----------------------------------------------------------------------------------------

@query("""select row_id, substr(sha1(regexp_replace(sql_text, '^[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+|[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+$', '', 'g')), 1, 12) as fingerprint
from spans where sql_text is not null""")
def exact_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spans").where("sql_text is not null").select("row_id", fingerprint.exact_hash(F.col("sql_text")).alias("fingerprint"))


@query("select row_id, sha1(regexp_replace(regexp_replace(sql_text, '/\\*(.|\\n)*?\\*/', ' ', 'g'), '--[^\\n]*', ' ', 'g')) as bare from spans where sql_text is not null")
def comments_stripped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spans").where("sql_text is not null").select("row_id", F.sha1(fingerprint.without_comments(F.col("sql_text"))).alias("bare"))


@query("select trace_id, span_id, label, case when parent_span_id is not null and parent_span_id <> '' then 'refine' else 'probe' end as class, count(*) as n from agent_events group by all")
def class_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agent_events").groupBy("trace_id", "span_id", "label", context.class_of(F.col("parent_span_id")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query()
def normalized_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spans").where("sql_text is not null").select("row_id", fingerprint.normalized_hash(F.col("sql_text")).alias("fingerprint"))


_BODY = "regexp_extract(line, '/\\*agenttrace:(.*?)\\*/', 1)"


def _wire(key: str) -> str:
    return f"regexp_extract(',' || {_BODY}, '.*,{key}=([^,]*)', 1)"


@query(f"""
select log_id, line_no, url_decode({_wire('t')}) as trace_id, url_decode({_wire('s')}) as span_id, nullif(nullif({_wire('p')}, ''), '-') as parent_span_id,
       url_decode({_wire('a')}) as agent_id, url_decode({_wire('i')}) as span_intent
from (select distinct log_id, line_no, line from query_log) where regexp_matches(line, '/\\*agenttrace:.*?\\*/')""")
def context_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "query_log").select("log_id", "line_no", "line").distinct()
    x = lines.withColumn("c", context.parse(F.col("line"))).where("c is not null")
    return x.select("log_id", "line_no", "c.trace_id", "c.span_id", "c.parent_span_id", "c.agent_id", "c.span_intent")


@query("""
select row_id, trace_id, span_id, nullif(parent_span_id, '') is null as no_parent, agent_id from spans where trace_id is not null and trace_id <> ''""")
def tag_round_trip(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "spans")
    tag = context.tag({k: F.col(k) for k in ("trace_id", "span_id", "parent_span_id", "agent_id", "speculation_class", "span_intent")})
    x = s.select("row_id", context.parse_tag(tag).alias("t")).where("t is not null")
    return x.select("row_id", "t.trace_id", "t.span_id", F.coalesce(F.col("t.parent_span_id") == "", F.lit(True)).alias("no_parent"), "t.agent_id")


@query("select row_id, trace_id, span_id, span_intent, attempt_n from spans where trace_id is not null and span_id is not null and span_intent is not null and attempt_n is not null")
def comment_round_trip(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "spans").where("trace_id is not null and span_id is not null and span_intent is not null and attempt_n is not null")
    sql = F.concat(context.comment({k: F.col(k) for k in context.KEYS.values() if k in s.columns}), F.lit(" select 1"))
    return s.select("row_id", context.parse(sql).alias("c")).select("row_id", "c.trace_id", "c.span_id", "c.span_intent", "c.attempt_n")


# --- the warehouse's own log -------------------------------------------------------------------------------------------

_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) (\S+) \[(\d+)\] (LOG|ERROR|STATEMENT|HINT|WARNING|DETAIL|FATAL):  (.*)$"
_RECORDS = f"""
lines as (select log_id, line_no, min(line) as line from query_log where log_id is not null and line_no is not null group by 1, 2),
recs as (
  select log_id, line_no, line, regexp_extract(line, '{_LINE}', 3) as pid, regexp_extract(line, '{_LINE}', 5) as rest,
         case when not coalesce(regexp_matches(line, '{_LINE}'), false) then 'more' when starts_with(regexp_extract(line, '{_LINE}', 5), 'statement: ') then 'statement'
              when regexp_matches(regexp_extract(line, '{_LINE}', 5), '^duration: [0-9.]+ ms') then 'duration' else 'other' end as kind
  from lines)"""
_MORE = """
owned as (select *, max(case when kind <> 'more' then line_no end) over (partition by log_id order by line_no) as owner from recs),
more as (select o.log_id, o.owner as line_no, string_agg(coalesce(o.line, ''), chr(10) order by o.line_no) as txt from owned o join recs h on h.log_id = o.log_id and h.line_no = o.owner
         where o.kind = 'more' and h.kind = 'statement' group by 1, 2)"""
_STATEMENT_COLUMNS = "t.log_id, t.line_no, t.pid, substr(t.rest, 12) || coalesce(chr(10) || more.txt, '') as sql, t.duration_ms"
_MS = "try_cast(regexp_extract(rest, '^duration: ([0-9.]+) ms', 1) as double)"


@query(f"""
with {_RECORDS}, {_MORE},
pending as (select *, last_value(case when kind in ('statement', 'other') then kind || ' ' || pid end ignore nulls) over (partition by log_id order by line_no rows between unbounded preceding and 1 preceding) as p from recs where kind <> 'more'),
kept as (select * from pending where kind <> 'duration' or p = 'statement ' || pid),
timed as (select *, case when lead(kind) over w = 'duration' then lead({_MS}) over w end as duration_ms from kept window w as (partition by log_id order by line_no))
select {_STATEMENT_COLUMNS} from timed t left join more on more.log_id = t.log_id and more.line_no = t.line_no where t.kind = 'statement'""")
def log_statements_slot(spark: SparkSession, d: str) -> DataFrame:
    return querylog.statements(table(spark, d, "query_log"), "slot").select("log_id", "line_no", "pid", "sql", "duration_ms")


@query(f"""
with {_RECORDS}, {_MORE},
timed as (select *, case when lead(kind) over w = 'duration' then lead({_MS}) over w end as duration_ms from recs where kind <> 'more' window w as (partition by log_id, pid order by line_no))
select {_STATEMENT_COLUMNS} from timed t left join more on more.log_id = t.log_id and more.line_no = t.line_no where t.kind = 'statement'""")
def log_statements_per_pid(spark: SparkSession, d: str) -> DataFrame:
    return querylog.statements(table(spark, d, "query_log"), "per_pid").select("log_id", "line_no", "pid", "sql", "duration_ms")


_TAG = "regexp_extract(sql, '/\\*agenttrace:(.*?)\\*/', 1)"


def _field(key: str, null: bool = False) -> str:
    """The last pair of a key; a key that is not there is null."""
    x = f"case when regexp_matches(',' || {_TAG}, ',{key}=') then url_decode(regexp_extract(',' || {_TAG}, '.*,{key}=([^,]*)', 1)) end"
    return f"nullif({x}, '-')" if null else x


@query(f"""
with {_RECORDS}, {_MORE},
timed as (select *, case when lead(kind) over w = 'duration' then lead({_MS}) over w end as duration_ms from recs where kind <> 'more' window w as (partition by log_id, pid order by line_no)),
st as (select {_STATEMENT_COLUMNS}, try_cast(regexp_extract(t.line, '{_LINE}', 1) as timestamp) as ts from timed t left join more on more.log_id = t.log_id and more.line_no = t.line_no where t.kind = 'statement'),
sp as (select *, regexp_replace(sql, '/\\*agenttrace:(.|\\n)*?\\*/\\s*', '') as sql_text from st where regexp_matches(sql, '/\\*agenttrace:.*?\\*/'))
select log_id, line_no, {_field('t')} as trace_id, {_field('s')} as span_id, {_field('p', True)} as parent_span_id, {_field('a')} as agent_id, {_field('m')} as model_id, {_field('c')} as speculation_class,
       try_cast({_field('n')} as int) as attempt_n, {_field('r', True)} as retry_of, {_field('i')} as span_intent, sql_text, epoch_ms(ts)::bigint as start_ms, coalesce(duration_ms, 0.0) as exec_ms,
       substr(sha1(regexp_replace(sql_text, '^[\\s\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+|[\\s\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+$', '', 'g')), 1, 12) as exact
from sp where {_field('t')} is not null""")
def log_span_fields(spark: SparkSession, d: str) -> DataFrame:
    """The spans of the log but for their normalized fingerprint."""
    return log_spans(spark, d).drop("ast")


@query()
def log_spans(spark: SparkSession, d: str) -> DataFrame:
    return querylog.spans(querylog.statements(table(spark, d, "query_log"), "per_pid"))


# --- billing -----------------------------------------------------------------------------------------------------------

_WINDOWS = f"""
{_SPANS},
iv as (select trace_key, span_key, (start_ms - min(start_ms) over (partition by trace_key)) / 1000.0::double as start_s, coalesce(exec_ms, 0.0) / 1000.0 as len from latest where start_ms is not null),
iv2 as (select *, start_s + len as end_s, start_s + len - start_s as own from iv),
op as (select *, max(end_s) over (partition by trace_key order by start_s, span_key rows between unbounded preceding and 1 preceding) as le from iv2),
wn as (select *, sum(case when le is null or start_s > le + 60 then 1 else 0 end) over (partition by trace_key order by start_s, span_key rows unbounded preceding) as window_no from op),
win as (select trace_key, window_no, min(start_s) as start_s, max(end_s) as end_s, count(*) as spans, sum(own) as productive_s, greatest(60.0::double, max(end_s) - min(start_s) + 60) as billed_s from wn group by 1, 2),
bil as (select trace_key, count(*) as windows, sum(spans)::bigint as spans, sum(billed_s) as billed_s, sum(productive_s) as productive_s from win group by 1)"""


@query(f"with {_WINDOWS} select trace_key, window_no::bigint as window_no, round(start_s, 6) as start_s, round(end_s, 6) as end_s, spans, round(billed_s, 6) as billed_s from win")
def billing_windows(spark: SparkSession, d: str) -> DataFrame:
    w = billing.windows(lineage.latest_spans(table(spark, d, "spans")), ["trace_key"], "span_key")
    return w.select("trace_key", "window_no", *[F.round(c, 6).alias(c) for c in ("start_s", "end_s")], "spans", F.round("billed_s", 6).alias("billed_s"))


@query(f"""
with {_WINDOWS}, last_ as (select trace_key, arg_max(end_s, (start_s, span_key)) as elapsed_s, sum(greatest(end_s - greatest(start_s, coalesce(le, start_s)), 0)) as busy_s from wn group by 1)
select trace_key, windows, spans, round(billed_s, 6) as billed_s, round(productive_s, 6) as productive_s, round(billed_s - productive_s, 6) as overhead_s,
       round(greatest(60.0::double, productive_s + 60), 6) as batched_s, round(elapsed_s, 6) as elapsed_s, round(busy_s, 6) as busy_s, round(billed_s / 3600 * 3, 10) as dollars
from bil join last_ using (trace_key)""")
def billing_summary(spark: SparkSession, d: str) -> DataFrame:
    b = billing.bill(lineage.latest_spans(table(spark, d, "spans")), ["trace_key"], "span_key")
    return b.select("trace_key", "windows", "spans", *[F.round(c, 6).alias(c) for c in ("billed_s", "productive_s", "overhead_s", "batched_s", "elapsed_s", "busy_s")], F.round("dollars", 10).alias("dollars"))


@query(f"""
with {_WINDOWS}
select trace_key, span_key, round(own + case when productive_s > 0 then own / productive_s * (billed_s - productive_s) else (billed_s - productive_s) / bil.spans end, 4) as billed_s
from wn join bil using (trace_key)""")
def billing_attribution(spark: SparkSession, d: str) -> DataFrame:
    return billing.attribute(lineage.latest_spans(table(spark, d, "spans")), ["trace_key"], "span_key").select("trace_key", "span_key", F.round("billed_s", 4).alias("billed_s"))


@query("""
with s as (select user_id, ts, value from events where ts is not null and value is not null and value >= 0),
o as (select *, ts + to_microseconds(cast(floor((value * 1000 + 60000)) as bigint) * 1000) as upto from s),
p as (select *, max(upto) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding) as le from o),
w as (select *, sum(case when le is null or ts > le then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as n from p)
select user_id, min(ts) as start, max(upto) as "end", count(*) as spans from w group by user_id, n""")
def session_resume_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("ts is not null and value is not null and value >= 0").withColumnRenamed("value", "exec_s")
    return streams.resume_windows(e, "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "spans")


# --- lineage -----------------------------------------------------------------------------------------------------------

@query(f"""
with {_SPANS}, {_EVENTS}
select latest.trace_key, latest.span_key, e.label, e.row_count, coalesce(e.used_downstream, false) as used_downstream, e.grounded
from latest left join latest_e e on e.trace_key = latest.trace_key and e.span_key = latest.span_key""")
def span_event_join(spark: SparkSession, d: str) -> DataFrame:
    return lineage.span_events(table(spark, d, "spans"), table(spark, d, "agent_events")).select("trace_key", "span_key", "label", "row_count", "used_downstream", "grounded")


@query(f"""
with {_SPANS}, l as (select *, {_PARENT} as pk from latest)
select a.trace_key, a.span_key from l a where a.pk is null or not exists (select 1 from l b where b.trace_key = a.trace_key and b.span_key = a.pk)""")
def tree_roots(spark: SparkSession, d: str) -> DataFrame:
    return lineage.roots(table(spark, d, "spans")).select("trace_key", "span_key")


@query(f"""
with recursive {_SPANS}, l as (select trace_key, span_key, {_PARENT} as pk, struct_pack(at := coalesce(start_ms, 0), id := span_key) as me from latest),
tree as (
  select trace_key, span_key, 0 as depth, [me] as path from l a where pk is null or not exists (select 1 from l b where b.trace_key = a.trace_key and b.span_key = a.pk)
  union all select l.trace_key, l.span_key, tree.depth + 1, list_append(tree.path, l.me) from tree join l on l.trace_key = tree.trace_key and l.pk = tree.span_key)
select trace_key as trace_id, span_key as span_id, depth, row_number() over (partition by trace_key order by path) as position from tree""")
def plan_tree(spark: SparkSession, d: str) -> DataFrame:
    return lineage.plan_tree(table(spark, d, "spans")).select("trace_id", F.lower("span_id").alias("span_id"), "depth", F.col("position").cast("long").alias("position"))


@query(f"""
with {_SPANS}, l as (select *, {_PARENT} as parent_key, coalesce(exec_ms, 0.0) as cost from latest),
lab as (select *, regexp_replace(regexp_replace(regexp_replace(span_intent, '\\d{{4}}-\\d\\d-\\d\\d', '<date>', 'g'), '\\b(AMER|EMEA|APAC)\\b', '<region>', 'g'), '\\b(paid_search|organic|partner|email)\\b', '<channel>', 'g') as label from l)
select trace_key, parent_key, label, count(*) as n, round(sum(cost), 3) as cost from lab group by 1, 2, 3 having count(*) > 1""")
def sibling_collapse(spark: SparkSession, d: str) -> DataFrame:
    s = lineage.latest_spans(table(spark, d, "spans")).withColumn("parent_key", lineage.clean_id(F.col("parent_span_id"))).withColumn("cost", F.coalesce("exec_ms", F.lit(0.0)))
    return lineage.sibling_groups(s, more_than=1).withColumn("cost", F.round("cost", 3))


@query(f"""
with {_SPANS}, {_EVENTS}, j as (select latest.agent_id, latest.span_intent, coalesce(latest.exec_ms, 0.0) as cost, coalesce(e.used_downstream, false) as used from latest left join latest_e e on e.trace_key = latest.trace_key and e.span_key = latest.span_key)
select agent_id, count(*) as spans, count(*) filter (used) as cited, round(sum(cost), 3) as cost, round(sum(case when not used then cost else 0.0 end), 3) as wasted,
       round(sum(case when not used and span_intent ilike '%refund%' then cost else 0.0 end), 3) as dead_end from j group by agent_id""")
def waste_split(spark: SparkSession, d: str) -> DataFrame:
    j = lineage.span_events(table(spark, d, "spans"), table(spark, d, "agent_events")).withColumn("cost", F.coalesce("exec_ms", F.lit(0.0)))
    return lineage.waste(j, "agent_id").select("agent_id", "spans", "cited", *[F.round(c, 3).alias(c) for c in ("cost", "wasted", "dead_end")])


@query("""
with e as (select *, row_number() over (partition by trace_id, label order by span_id) as rn from (select distinct trace_id, span_id, label from agent_events where label is not null and trace_id is not null and span_id is not null)),
calls as (select trace_id, span_id, label, 'q' || (try_cast(substr(label, 2) as int) - 1) as follows_from from e where rn = 1)
select c.trace_id, c.span_id, c.label, p.span_id as parent_span_id from calls c left join calls p on p.trace_id = c.trace_id and p.label = c.follows_from""")
def follow_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "agent_events").where("label is not null and trace_id is not null and span_id is not null").groupBy("trace_id", "label").agg(F.min("span_id").alias("span_id"))
    e = e.withColumn("follows_from", F.concat(F.lit("q"), (F.substring("label", 2, 20).try_cast("int") - 1).cast("string")))
    return lineage.follow_labels(e).select("trace_id", "span_id", "label", "parent_span_id")


_EVENT_COLUMNS = "trace_id, span_id, parent_span_id, label, speculation_class, span_intent, attempt_n, retry_of, result_hash, client_ms, error, used_downstream, grounded"


@query(f"select {_EVENT_COLUMNS}, row_count as rows, array_to_string(result_values, '|') as value_text from agent_events")
def events_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All events written as JSON lines and read again."""
    e = table(spark, d, "agent_events").withColumnsRenamed({"row_count": "rows", "result_values": "values"})
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    querylog.write_events(e, path)
    return querylog.read_events(spark, [path, path + "-missing"]).select(*_EVENT_COLUMNS.split(", "), "rows", F.array_join("values", "|").alias("value_text"))


@query("select lower(query_type) as kind, count(*) as queries, count(distinct database_id) as databases from (select * from r union all select * from r) group by 1")
def fleet_parts(spark: SparkSession, d: str) -> DataFrame:
    """A fleet trace of two parts (here the same one twice)."""
    parts = querylog.read_fleet(spark, f"{d}/r.parquet", f"{d}/r.parquet")
    return parts.groupBy(F.lower("query_type").alias("kind")).agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("database_id").alias("databases"))


@query("select row_id as query_id, exec_ms as total_elapsed_time from spans order by ingested_at desc nulls last, row_id limit 10000")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    """What a history source hands out: its 10,000 newest rows."""
    h = table(spark, d, "spans").select(F.col("row_id").alias("query_id"), F.col("exec_ms").alias("total_elapsed_time"), F.col("ingested_at").alias("start_time"))
    return measured.recent(h).drop("start_time")


# --- grounding -----------------------------------------------------------------------------------------------------------

def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Every text of a trace, whatever its source."""
    return table(spark, d, "documents").where("trace_id is not null and text is not null and text <> ''").select("trace_id", "text")


_UNIQUE_EVENTS = "ev as (select trace_id, span_id, arg_min(label, coalesce(label, '')) as label, arg_max(result_values, (logged_at, coalesce(label, ''), array_to_string(result_values, ','))) as result_values from agent_events where trace_id is not null and span_id is not null and result_values is not null group by 1, 2)"


def _unique_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "agent_events").where("trace_id is not null and span_id is not null and result_values is not null")
    return e.groupBy("trace_id", "span_id").agg(F.min_by("label", F.coalesce("label", F.lit(""))).alias("label"), F.max_by("result_values", F.struct("logged_at", F.coalesce("label", F.lit("")), F.array_join("result_values", ","))).alias("result_values"))


@query("""
select doc_id, count(n) as numbers, round(coalesce(sum(n), 0), 3) as total from documents left join lateral (select unnest(regexp_extract_all(text, '(?-i)-?\\d[\\d,]*')) as raw) on true
left join lateral (select try_cast(replace(raw, ',', '') as double) as n) on true where text is not null group by doc_id""")
def integers_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Runs of digits in a text, with thousands separators removed: the part of number extraction SQL can express."""
    docs = table(spark, d, "documents").where("text is not null")
    found = F.array_compact(F.transform(F.regexp_extract_all("text", F.lit(r"-?[0-9][0-9,]*"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")))
    return docs.select("doc_id", F.size(found).cast("long").alias("numbers"), F.round(F.aggregate(found, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


_NUMBERS = "(?i)(-?\\d[\\d,]*\\.?\\d*)\\s*(k|m|b|bn|t)?\\b"
#: SQL of the numbers of a text in order, those with a suffix also scaled.
_NUMBER_LIST = f"""
flatten(list_transform(list_zip(regexp_extract_all(text, '{_NUMBERS}', 1), list_transform(regexp_extract_all(text, '{_NUMBERS}', 2), lambda x: lower(x))),
  lambda h: list_filter([try_cast(replace(h[1], ',', '') as double), try_cast(replace(h[1], ',', '') as double) * case h[2] when 'k' then 1e3 when 'm' then 1e6 when 'b' then 1e9 when 'bn' then 1e9 when 't' then 1e12 end], lambda y: y is not null)))"""


@query(f"select doc_id, unnest(n) as number, generate_subscripts(n, 1) - 1 as pos from (select doc_id, {_NUMBER_LIST} as n from documents where text is not null)")
def numbers_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Every number of every text, with its place."""
    n = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.numbers(F.col("text"))).alias("pos", "number"))
    return n.select("doc_id", "number", F.col("pos").cast("long").alias("pos"))


@query(f"""
with {_UNIQUE_EVENTS}, v as (select distinct trace_id, span_id, case when regexp_matches(trim(x), '^-?[0-9]+(\\.[0-9]+)?$') then 'n:' || cast(trim(x) as double)::varchar else 's:' || x end as norm from (select trace_id, span_id, unnest(result_values) as x from ev) where x is not null)
select trace_id, sets, count(*) as values from (select trace_id, norm, count(*) as sets from v group by 1, 2) group by 1, 2""")
def value_frequency(spark: SparkSession, d: str) -> DataFrame:
    f = grounding.value_frequency(_unique_events(spark, d), ["trace_id"], ["trace_id", "span_id"])
    return f.groupBy("trace_id", "sets").agg(F.count(F.lit(1)).alias("values"))


#: SQL of the texts of a trace, the values of its events, and which of them a text holds.
_HITS = f"""
{_UNIQUE_EVENTS},
texts as (select trace_id, lower(text) as low, {_NUMBER_LIST} as n from documents where trace_id is not null and text is not null and text <> ''),
vals as (select trace_id, span_id, unnest(result_values) as value, generate_subscripts(result_values, 1) as pos from ev),
v as (select *, case when regexp_matches(trim(value), '^-?[0-9]+(\\.[0-9]+)?$') then trim(value)::double end as num from vals where value is not null),
k as (select *, case when num is not null then 'n:' || num::varchar else 's:' || value end as norm from v),
freq as (select trace_id, norm, count(*) as sets from (select distinct trace_id, span_id, norm from k) group by 1, 2),
hits as (select k.trace_id, k.span_id, k.pos, k.value, freq.sets,
                bool_or(case when k.num is not null then len(list_filter(t.n, lambda a: abs(a - k.num) / greatest(abs(k.num), 1) <= 0.02)) > 0
                             else length(trim(k.value)) >= 3 and (contains(t.low, lower(trim(k.value))) or coalesce(contains(t.low, lower(strftime(case when regexp_matches(trim(k.value), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then try_cast(trim(k.value) as date) end, '%B %-d'))), false)) end) as hit
         from k join freq on freq.trace_id = k.trace_id and freq.norm = k.norm join texts t on t.trace_id = k.trace_id group by all),
flags as (select ev.trace_id, ev.span_id, ev.label, coalesce(bool_or(h.hit), false) as grounded, coalesce(bool_or(h.hit and h.sets = 1), false) as uniquely_grounded,
                 coalesce(array_to_string(list_slice(list(h.value order by h.pos) filter (h.hit), 1, 4), '|'), '') as evidence_text
          from ev left join hits h on h.trace_id = ev.trace_id and h.span_id = ev.span_id where ev.trace_id in (select trace_id from texts) group by 1, 2, 3)"""


@query()
def grounding_flags(spark: SparkSession, d: str) -> DataFrame:
    return grounding.verify(_unique_events(spark, d), _answers(spark, d), ["trace_id"], ["trace_id", "span_id"])


@query(f"with {_HITS} select trace_id, span_id, grounded, uniquely_grounded, evidence_text from flags")
def grounding_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The flags with their evidence as text."""
    return grounding_flags(spark, d).withColumn("evidence_text", F.array_join("evidence", "|")).drop("evidence")


_CITED_DOCS = r"""
docs as (select doc_id, regexp_extract(text, '(?mi)^[\s*_#>\-]*CITED:\s*(.+?)[\s*_]*$', 1) as body from documents where text is not null)"""


@query(f"""
with {_CITED_DOCS}
select doc_id, label from (select doc_id, unnest(list_distinct(list_transform(regexp_split_to_array(body, '[,\\s]+'), lambda x: lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'))))) as label from docs where body <> '') where label <> ''""")
def cited_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", T.cited(F.col("text")).alias("c"))
    return docs.select("doc_id", F.explode("c").alias("label"))


@query(f"""
with {_HITS},
cites as (select trace_id, regexp_extract(text, '(?mi)^[\\s*_#>\\-]*CITED:\\s*(.+?)[\\s*_]*$', 1) as body from documents where trace_id is not null and text is not null and text <> ''),
labels as (select trace_id, list_distinct(flatten(list(list_transform(regexp_split_to_array(body, '[,\\s]+'), lambda x: lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')))))) as cited from cites where body <> '' group by 1),
x as (select f.*, coalesce(list_contains(l.cited, lower(f.label)), false) as claimed from flags f left join labels l on l.trace_id = f.trace_id)
select trace_id, count(*) as events, count(*) filter (claimed) as claimed, count(*) filter (grounded) as grounded, count(*) filter (uniquely_grounded) as "unique",
       count(*) filter (claimed and not grounded) as claimed_ungrounded, count(*) filter (not claimed and grounded) as grounded_unclaimed from x group by 1""")
def citation_totals(spark: SparkSession, d: str) -> DataFrame:
    e, a = _unique_events(spark, d), _answers(spark, d)
    v = grounding.verify(e, a, ["trace_id"], ["trace_id", "span_id"])
    c = grounding.claims(e, a, ["trace_id"]).select("trace_id", "span_id", "claimed")
    return grounding.totals(v.join(c, ["trace_id", "span_id"], "left"), "trace_id")


# --- measured cost ---------------------------------------------------------------------------------------------------------

def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "spans")
    tag = context.tag({k: F.col(k) for k in ("trace_id", "span_id", "agent_id", "speculation_class")})
    h = s.select(F.col("row_id").alias("query_id"), tag.alias("query_tag"), F.coalesce("exec_ms", F.lit(0.0)).alias("total_elapsed_time"), F.length("sql_text").alias("bytes_scanned"))
    # credits in parts of a power of two, so that sums do not depend on their order
    return h, s.where("exec_ms > 100").select(F.col("row_id").alias("query_id"), (F.round("exec_ms") / 4194304.0).alias("credits_attributed_compute"))


@query("""
select trace_id, sum(case when exec_ms > 100 then round(exec_ms) / 4194304.0::double end) as credits, round(sum(coalesce(exec_ms, 0.0)), 3) as elapsed_ms, sum(length(sql_text))::bigint as bytes_scanned,
       count(*) as queries, count(case when exec_ms > 100 then 1 end) as attributed
from spans where trace_id is not null and trace_id <> '' group by trace_id""")
def measured_per_trace(spark: SparkSession, d: str) -> DataFrame:
    h, a = _history(spark, d)
    x = measured.per_trace(measured.tagged(h), a)
    return x.select("trace_id", "credits", F.round("elapsed_ms", 3).alias("elapsed_ms"), "bytes_scanned", "queries", "attributed")


@query("""
with t as (select trace_id, sum(case when exec_ms > 100 then round(exec_ms) / 4194304.0::double end) as credits from spans where trace_id is not null and trace_id <> '' group by 1)
select count(*) as traces, round(sum(credits), 6) as credits, round(sum(credits) * 3 / count(*), 8) as cost_per_task, round(sum(credits) * 3 / count(*) / 0.073::double, 6) as ratio from t""")
def measured_summary(spark: SparkSession, d: str) -> DataFrame:
    h, a = _history(spark, d)
    x = measured.summary(measured.per_trace(measured.tagged(h), a))
    return x.select("traces", F.round("credits", 6).alias("credits"), F.round("cost_per_task", 8).alias("cost_per_task"), F.round("ratio", 6).alias("ratio"))


# --- rollups -----------------------------------------------------------------------------------------------------------------

_DAY = "date_trunc('day', o_orderdate)"
_DAILY = Shape("orders", ("count(*)", "count(o_totalprice)", "max(o_totalprice)", "min(o_totalprice)", "sum(o_totalprice)"), (_DAY, "o_orderpriority", "o_orderstatus"))
_PLAIN = Shape("orders", ("count(*)", "sum(o_totalprice)"), ("o_orderdate", "o_orderpriority", "o_orderstatus"))


def _from_rollup(spark: SparkSession, d: str, anchor: Shape, wanted: Shape, names: dict[str, str]) -> DataFrame:
    a = rollup.answer(rollup.build(table(spark, d, anchor.table), anchor), anchor, wanted)
    return a.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


@query("select date_trunc('month', o_orderdate) as month, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def rollup_day_to_month(spark: SparkSession, d: str) -> DataFrame:
    x = _from_rollup(spark, d, _PLAIN, Shape("orders", ("count(*)", "sum(o_totalprice)"), ("date_trunc('month', o_orderdate)",)), {"date_trunc('month', o_orderdate)": "month", "count(*)": "n", "sum(o_totalprice)": "total"})
    return x.withColumn("total", F.round("total", 2))


@query("select o_orderpriority, count(*) as n, max(o_totalprice) as most, min(o_totalprice) as least from orders where o_orderstatus = 'F' group by 1")
def rollup_cell(spark: SparkSession, d: str) -> DataFrame:
    return _from_rollup(spark, d, _DAILY, Shape("orders", ("count(*)", "max(o_totalprice)", "min(o_totalprice)"), ("o_orderpriority",), ("o_orderstatus = 'F'",), ("o_orderstatus",)), {"o_orderpriority": "o_orderpriority", "count(*)": "n", "max(o_totalprice)": "most", "min(o_totalprice)": "least"})


@query("select o_orderstatus, round(avg(o_totalprice), 4) as mean from orders group by 1")
def rollup_average(spark: SparkSession, d: str) -> DataFrame:
    x = _from_rollup(spark, d, _DAILY, Shape("orders", ("avg(o_totalprice)",), ("o_orderstatus",)), {"o_orderstatus": "o_orderstatus", "avg(o_totalprice)": "mean"})
    return x.withColumn("mean", F.round("mean", 4))


@query("select count(*) as n, round(sum(o_totalprice), 2) as total from orders")
def rollup_total(spark: SparkSession, d: str) -> DataFrame:
    x = _from_rollup(spark, d, _DAILY, Shape("orders", ("count(*)", "sum(o_totalprice)")), {"count(*)": "n", "sum(o_totalprice)": "total"})
    return x.withColumn("total", F.round("total", 2))


#: A small workload of shapes, for the matcher's queries whose SQL spells it out; span_candidate_dims, span_cover_edges, cover_anchors and span_subexpressions take all statements.
WORKLOAD = (
    Shape("orders", ("count(*)", "sum(amount)"), ("region",)), Shape("orders", ("avg(amount)",), (), ("region = 'EMEA'",), ("region",)), Shape("orders", ("max(amount)",), ("channel",), ("day >= '2026-07-01'",)),
    Shape("orders", ("count(*)",), ("date_trunc('month', day)",)), Shape("orders", ("count(*)", "sum(amount)"), ("day",)), Shape("orders", ("count(distinct customer)",), ("region",)),
    Shape("orders", ("count(distinct customer)",)), Shape("refunds", ("sum(fee)",), (), ("desk = 'north'", "reason = 'late'"), ("desk", "reason")), Shape("refunds", ("count(*)", "min(fee)"), ("desk",)),
)


def _workload(spark: SparkSession) -> DataFrame:
    return rollup.frame(spark, enumerate(WORKLOAD))


def _values() -> str:
    def lst(xs: tuple[str, ...]) -> str:
        return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]::varchar[]"
    rows = ", ".join(f"({i}, '{s.table}', {lst(s.measures)}, {lst(s.groupby)}, {lst(s.filters)}, {lst(s.eq_cols)})" for i, s in enumerate(WORKLOAD))
    return f"shapes as (select * from (values {rows}) t(shape_id, tab, measures, groupby, filters, eq_cols))"


_DIMS = "dims as (select tab, shape_id, list_sort(list_distinct(list_concat(groupby, eq_cols))) as dims from shapes)"


@query(f"""
with {_values()}, {_DIMS},
each as (select distinct tab, dims from dims), whole as (select tab, list_sort(list_distinct(flatten(list(dims)))) as dims from dims group by tab having len(flatten(list(dims))) > 0)
select tab as "table", array_to_string(dims, '|') as dims, false as all_dims from each union all select tab, array_to_string(dims, '|'), true from whole""")
def candidate_dims(spark: SparkSession, d: str) -> DataFrame:
    c = rollup.candidates(_workload(spark))
    return c.select("table", F.array_join("groupby", "|").alias("dims"), (F.col("whole") == 1).alias("all_dims"))


@query(f"""
with {_values()}
select a.shape_id as anchor_id, q.shape_id as shape_id from shapes a join shapes q on a.tab = q.tab
where len(list_filter(a.filters, lambda f: not list_contains(q.filters, f))) = 0
and len(list_filter(q.measures, lambda m: not (
      case when starts_with(m, 'count(distinct ') then list_contains(a.measures, m) and len(a.groupby) = 0
           when starts_with(m, 'avg(') then list_contains(a.measures, 'sum(' || m[5:]) and len(list_filter(a.measures, lambda x: starts_with(x, 'count(') and not contains(x, 'distinct'))) > 0
           else list_contains(a.measures, m) end))) = 0
and len(list_filter(q.groupby, lambda g: not (list_contains(a.groupby, g) or (starts_with(g, 'date_trunc(') and list_contains(a.groupby, regexp_extract(g, ', ([a-z_]+)\\)', 1)))))) = 0
and len(list_filter(q.filters, lambda f: not list_contains(a.filters, f) and not (regexp_extract(f, '^([a-z_]+)\\s*=', 1) <> '' and list_contains(a.groupby, regexp_extract(f, '^([a-z_]+)\\s*=', 1))))) = 0""")
def cover_edges(spark: SparkSession, d: str) -> DataFrame:
    e = rollup.edges(_workload(spark)).where("rank.o = 1")
    return e.select(F.col("rank.at").cast("int").alias("anchor_id"), F.col("shape_id").cast("int").alias("shape_id"))


@query(f"""
with {_values()}, {_DIMS},
pool as (select distinct tab, dims from dims union select tab, list_sort(list_distinct(flatten(list(dims)))) as dims from dims group by tab having len(flatten(list(dims))) > 0),
offered as (select tab, list_distinct(list_append(flatten(list(list_transform(list_filter(measures, lambda m: not starts_with(m, 'count(distinct ')), lambda m: case when starts_with(m, 'avg(') then 'sum(' || m[5:] else m end))), 'count(*)')) as measures from shapes group by tab)
select distinct a.tab as "table", array_to_string(a.dims, '|') as dims, q.shape_id from pool a join offered o on o.tab = a.tab join shapes q on q.tab = a.tab
where len(list_filter(q.measures, lambda m: not (case when starts_with(m, 'avg(') then list_contains(o.measures, 'sum(' || m[5:]) else list_contains(o.measures, m) end))) = 0
and len(list_filter(q.groupby, lambda g: not (list_contains(a.dims, g) or (starts_with(g, 'date_trunc(') and list_contains(a.dims, regexp_extract(g, ', ([a-z_]+)\\)', 1)))))) = 0
and len(list_filter(q.filters, lambda f: not (regexp_extract(f, '^([a-z_]+)\\s*=', 1) <> '' and list_contains(a.dims, regexp_extract(f, '^([a-z_]+)\\s*=', 1))))) = 0""")
def synthetic_edges(spark: SparkSession, d: str) -> DataFrame:
    """Which synthesized rollups answer which shapes of the small workload."""
    w = _workload(spark)
    e = rollup.edges(w).where("rank.o = 0").select("rank", "shape_id")
    return e.join(rollup.pool(w).select("rank", "table", F.array_join("groupby", "|").alias("dims")), "rank").select("table", "dims", F.col("shape_id").cast("int").alias("shape_id")).distinct()


def _span_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The distinct shapes of all modelled statements, with their number."""
    s = extract.shapes(lineage.latest_spans(table(spark, d, "spans")).where("sql_text is not null"), "sql_text", "row_id").where("reason is null")
    return cut(rollup.distinct(s), name="shapes")  # read several times


@query()
def cover_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The covering set of all modelled statements: a row a shape, with its rollup and its number of statements."""
    return rollup.cover_rows(_span_shapes(spark, d)).withColumnRenamed("n", "statements")


@query()
def anchor_sessions(spark: SparkSession, d: str) -> DataFrame:
    """How many traces each rollup of the covering set answers statements of."""
    spans = lineage.latest_spans(table(spark, d, "spans")).where("sql_text is not null")
    s = extract.shapes(spans, "sql_text", "row_id").where("reason is null").join(spans.select(F.col("row_id").alias("shape_id"), "trace_key"), "shape_id")
    return reports.anchor_sessions(cut(s, name="modelled"), "trace_key")


@query()
def span_cover_edges(spark: SparkSession, d: str) -> DataFrame:
    """Which shape of a statement answers which other, of all modelled statements; statements: those of the answered shape."""
    e = rollup.edges(_span_shapes(spark, d)).where("rank.o = 1")
    return e.select(F.col("rank.at").alias("anchor_id"), "shape_id", F.col("n").alias("statements"))


@query()
def span_candidate_dims(spark: SparkSession, d: str) -> DataFrame:
    """The dimensions of the rollups synthesized for all modelled statements."""
    c = rollup.candidates(_span_shapes(spark, d))
    return c.select("table", F.array_join("groupby", "|").alias("dims"), (F.col("whole") == 1).alias("all_dims"))


@query(f"""
with {_values()}, p as (
  select 1 as size, 'scan' as kind, 'scan(' || tab || ')' as key from shapes union all
  select 1, 'filter', 'scan(' || tab || ')|' || f from shapes, unnest(filters) u(f) union all
  select 2, 'filtered_scan', 'scan(' || tab || ')|' || array_to_string(filters, '&') from shapes union all
  select 2, 'measure', 'scan(' || tab || ')|' || m from shapes, unnest(measures) u(m) union all
  select 3, 'grouping', 'scan(' || tab || ')|by:' || array_to_string(groupby, ',') from shapes where len(groupby) > 0 union all
  select 4, 'full_agg', 'scan(' || tab || ')|' || array_to_string(filters, '&') || '|by:' || array_to_string(groupby, ',') || '|' || array_to_string(measures, ',') from shapes)
select size, kind, count(*) as total, count(distinct key) as "distinct", count(distinct key) / count(*)::double as ratio from p group by 1, 2
union all select 0, 'all', count(*), count(distinct key), count(distinct key) / count(*)::double from p""")
def subexpr_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rollup.subexpression_ratios(rollup.subexpressions(_workload(spark)))


@query()
def span_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The shape of every statement, or why it has none."""
    return extract.shapes(table(spark, d, "spans").where("sql_text is not null"), "sql_text", "row_id")


@query()
def span_subexpressions(spark: SparkSession, d: str) -> DataFrame:
    """Sub-expression totals and distinct counts of all modelled statements, by size and kind."""
    s = extract.shapes(lineage.latest_spans(table(spark, d, "spans")).where("sql_text is not null"), "sql_text", "row_id").where("reason is null")
    return rollup.subexpression_ratios(rollup.subexpressions(s))


@query("""
select * from (values ('select count(*) from orders', true), ('drop table orders', false), ('select 1; delete from orders', false), ('', false), ('with a as (select 1 as x) select x from a', true), ('insert into orders select * from orders', false)) t(sql, allowed)""")
def read_only_guard(spark: SparkSession, d: str) -> DataFrame:
    tries = ["select count(*) from orders", "drop table orders", "select 1; delete from orders", "", "with a as (select 1 as x) select x from a", "insert into orders select * from orders"]
    return spark.createDataFrame([(s, refusal(spark, s) is None) for s in tries], "sql string, allowed boolean")


# --- sessions ------------------------------------------------------------------------------------------------------------------

@query(f"with {_SPANS} select trace_key, count(*) as spans, count(distinct agent_id) as agents, min(start_ms) as first_ms from latest group by 1")
def session_sizes(spark: SparkSession, d: str) -> DataFrame:
    return lineage.latest_spans(table(spark, d, "spans")).groupBy("trace_key").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("agent_id").alias("agents"), F.min("start_ms").alias("first_ms"))


@query(f"with {_SPANS} select ast, count(*) as spans, count(distinct trace_key) as sessions from latest where ast is not null group by 1")
def sessions_per_statement(spark: SparkSession, d: str) -> DataFrame:
    return lineage.latest_spans(table(spark, d, "spans")).where("ast is not null").groupBy("ast").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("trace_key").alias("sessions"))


@query("select 4392000 as orders, 61 as days, 3 as regions, 4 as channels, 'ok' as amounts")
def synthetic_warehouse(spark: SparkSession, d: str) -> DataFrame:
    o = querylog.warehouse_orders(spark)
    odd = (F.col("region") == "EMEA") & (F.col("channel") == "paid_search") & (F.col("order_date") >= "2026-07-12")
    fine = F.bool_and(F.when(odd, F.col("amount").between(10, 40)).otherwise(F.col("amount").between(40, 260)))
    return o.agg(F.count(F.lit(1)).cast("int").alias("orders"), F.count_distinct("order_date").cast("int").alias("days"), F.count_distinct("region").cast("int").alias("regions"), F.count_distinct("channel").cast("int").alias("channels"), F.when(fine, "ok").otherwise("off").alias("amounts"))


# --- the SQL surface traced statements use ---------------------------------------------------------------------------------------

def _sql(text: str, oracle: str | None = None, name: str = ""):
    """Registers a statement that runs on Spark SQL as it stands (or with ``oracle`` where the dialects differ)."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in ("orders", "lineitem", "customer", "nation", "part"):
            if t in text:
                table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(text)
    run.__name__ = name
    query(oracle or text)(run)


_sql("select l_returnflag, round(percentile_cont(0.5) within group (order by l_quantity), 6) as p50, round(percentile_cont(0.95) within group (order by l_extendedprice), 6) as p95 from lineitem group by l_returnflag", name="delegated_percentile")
_sql("select o_orderstatus, count(*) filter (where o_totalprice > 100000) as big, count(*) as n from orders group by 1", name="delegated_filter")
_sql("select o_orderpriority as k, count(*) as n from orders group by 1 union all select o_orderstatus, count(*) from orders group by 1", name="delegated_union_all")
_sql("with a as (select o_custkey, count(*) as n from orders group by o_custkey), b as (select max(n) as most from a) select a.o_custkey, a.n from a join b on a.n = b.most", name="delegated_cte")
_sql("select c.c_custkey, coalesce(o.n, 0) as n from customer c left join (select o_custkey, count(*) as n from orders group by o_custkey) o on o.o_custkey = c.c_custkey", name="delegated_left_join")
_sql("select count(*) as n from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)", name="delegated_not_in")
_sql("select distinct o_orderstatus, o_orderpriority from orders", name="delegated_distinct")
_sql("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20", name="delegated_top_k")
_sql("select l_linestatus, sum(case when l_discount > 0.05 then 1 else 0 end) as discounted, round(stddev(l_quantity), 6) as sd from lineitem group by 1", "select l_linestatus, sum(case when l_discount > 0.05::double then 1 else 0 end)::bigint as discounted, round(stddev(l_quantity), 6) as sd from lineitem group by 1", name="delegated_case_stddev")
_sql("select o_orderstatus, round(sum(o_totalprice) / nullif(count(*) - count(o_custkey), 0), 2) as ratio, coalesce(max(o_orderpriority), '-') as top from orders group by 1", name="delegated_nullif_coalesce")
_sql("select extract(dow from o_orderdate) - 1 as dow, count(*) as n from orders group by 1", "select extract(dow from o_orderdate)::int as dow, count(*) as n from orders group by 1", name="delegated_dow")
_sql("select count(*) as n from lineitem where l_quantity between 10 and 20 and l_shipdate >= timestamp '1995-01-01 00:00:00'", name="delegated_between")
_sql("select n.n_name, count(*) as customers, (select count(*) from customer) as everyone from nation n join customer c on c.c_nationkey = n.n_nationkey group by n.n_name", name="delegated_scalar_subquery")
_sql("select round(cast(avg(o_totalprice) as decimal(38, 10)), 2) as mean from orders", "select round(avg(o_totalprice), 2)::decimal(38, 2) as mean from orders", name="delegated_numeric_cast")
_sql("select p_brand, p_size, p_partkey from part order by p_brand, p_size, p_partkey limit 10 offset 5", name="delegated_limit_offset")
_sql("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as rn from orders", name="delegated_row_number")


# --- written cases: statements, matches and covering sets with the results they must have -----------------------------------------

#: Statements and what they are modelled as (table, measures, group keys, filters); None where a rollup could not serve them.
SHAPE_CASES: tuple[tuple[str, tuple[str, str, str, str] | None], ...] = (
    ("select order_date, sum(amount) from orders group by order_date", ("orders", "sum(amount)", "order_date", "")),
    ("SELECT COUNT(*), AVG(x.amount) FROM orders x WHERE x.region = 'EMEA' AND x.channel = 'email'", ("orders", "avg(amount) ; count(*)", "", "channel = 'email' ; region = 'EMEA'")),
    ("select avg(amount), count(1) from orders where channel = 'email' and region = 'EMEA'", ("orders", "avg(amount) ; count(*)", "", "channel = 'email' ; region = 'EMEA'")),
    ("select date_trunc('month', order_date) as m, count(*) from orders group by 1", ("orders", "count(*)", "date_trunc('month', order_date)", "")),
    ("select date_trunc('month', order_date) as m, count(*) from orders group by m order by m limit 3", ("orders", "count(*)", "date_trunc('month', order_date)", "")),
    ("select region, channel, min(amount), max(amount) from orders where order_date >= '2026-07-01' group by channel, region", ("orders", "max(amount) ; min(amount)", "channel ; region", "order_date >= '2026-07-01'")),
    ("select count(distinct customer_id) from orders", ("orders", "count(distinct customer_id)", "", "")), ("select d::date, count(*) from t group by d::date", ("t", "count(*)", "d::date", "")),
    ("select sum(a + b) from t where k in (1, 2) and z <> 3", ("t", "sum(a + b)", "", "k in (1, 2) ; z <> 3")), ("select sum(a * (b + 1)) from t where x between 1 and 5", ("t", "sum(a * (b + 1))", "", "x between 1 and 5")),
    ("select * from orders", None), ("select region from orders", None), ("select count(*) from a join b on a.x = b.x", None), ("with c as (select 1 as x) select count(*) from c", None), ("select count(*) from t where a = 1 or b = 2", None),
    ("select a, count(*) from t group by a having count(*) > 1", None), ("select sum(a) over () from t", None), ("select count(*) from t where a in (select b from u)", None), ("select count(*) from (select 1 as x)", None), ("select count(*) from t; select 1", None),
    ("nonsense", None), ("select count(*) filter (where a > 1) from t", None), ("select count(*) from t union all select 1", None), ("select sum(a) / count(*), count(*) from t", None), ("select distinct count(*) from t", None),
)
#: Rollup, query, and whether the one answers the other.
MATCH_CASES = (
    ("select order_date, sum(amount) from orders group by order_date", "select sum(amount) from orders where order_date = '2026-07-12'", True), ("select region, channel, sum(amount) from orders group by region, channel", "select sum(amount) from orders where region = 'EMEA' and channel = 'email'", True),
    ("select region, sum(amount), count(*) from orders group by region", "select avg(amount) from orders where region = 'EMEA'", True), ("select region, channel, sum(amount) from orders group by region, channel", "select region, sum(amount) from orders group by region", True),
    ("select order_date, count(*) from orders group by order_date", "select date_trunc('month', order_date), count(*) from orders group by 1", True), ("select date_trunc('month', order_date), count(*) from orders group by 1", "select order_date, count(*) from orders group by order_date", False),
    ("select region, sum(amount) from orders group by region", "select sum(amount) from orders where channel = 'email'", False), ("select region, sum(amount) from orders where channel = 'email' group by region", "select region, sum(amount) from orders group by region", False),
    ("select region, sum(amount) from refunds group by region", "select region, sum(amount) from orders group by region", False), ("select region, sum(amount) from orders group by region", "select region, max(amount) from orders group by region", False),
    ("select region, avg(amount) from orders group by region", "select avg(amount) from orders", False), ("select region, sum(amount) from orders group by region", "select avg(amount) from orders", False), ("select region, sum(amount) from orders group by region", "select channel, sum(amount) from orders group by channel", False),
    ("select region, count(distinct customer_id) from orders group by region", "select count(distinct customer_id) from orders", False), ("select order_date, sum(amount) from orders group by order_date", "select sum(amount) from orders where order_date >= '2026-07-01'", False),
    ("select order_date, sum(amount) from orders where order_date >= '2026-07-01' group by order_date", "select sum(amount) from orders where order_date >= '2026-07-01'", True),
)
#: Workloads, and the number of rollups and of statements they answer.
COVER_CASES = {
    "one-day probes": ([f"select sum(amount) from orders where order_date = '2026-07-{x:02d}'" for x in range(1, 32)], 1, 31), "two tables": (["select sum(amount) from orders where region = 'EMEA'", "select sum(amount) from refunds where desk = 'north'"], 2, 2),
    "no rollup": (["select avg(amount) from orders where order_date >= '2026-07-01' group by region"], 0, 0), "the same twice": (["select region, count(*) from orders group by region"] * 2, 1, 2),
}


def _rows(values: list[tuple], names: str) -> str:
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(cell, v)) + ')' for v in values)}) t({names})"


def _shaped(spark: SparkSession, statements: list[str]) -> DataFrame:
    ship(spark)
    return extract.shapes(spark.createDataFrame(list(enumerate(statements)), "i long, sql string"), "sql", "i")


@query(_rows([(i, *(want or (None,) * 4)) for i, (_, want) in enumerate(SHAPE_CASES)], "case_no, tab, measures, groupby, filters"))
def shape_cases(spark: SparkSession, d: str) -> DataFrame:
    """What the written statements are modelled as."""
    s = _shaped(spark, [sql for sql, _ in SHAPE_CASES])
    return s.select(F.col("shape_id").cast("int").alias("case_no"), F.col("table").alias("tab"), *[F.when(F.col("table").isNotNull(), F.array_join(c, " ; ")).alias(c) for c in ("measures", "groupby", "filters")])


@query(_rows([(i, want) for i, (_, _, want) in enumerate(MATCH_CASES)], "case_no, answered"))
def match_cases(spark: SparkSession, d: str) -> DataFrame:
    """Which of the written queries their rollups answer."""
    a = _shaped(spark, [a for a, _, _ in MATCH_CASES]).select("shape_id", F.struct("table", "filters", rollup.offers_column().alias("have")).alias("a"))
    q = _shaped(spark, [q for _, q, _ in MATCH_CASES]).select("shape_id", F.struct("table", "filters", rollup.needs_column().alias("need")).alias("q"))
    return a.join(q, "shape_id").select(F.col("shape_id").cast("int").alias("case_no"), rollup.subsumes_column().alias("answered"))


@query(_rows([(name, anchors, covered) for name, (_, anchors, covered) in COVER_CASES.items()], "workload, anchors, covered"))
def cover_cases(spark: SparkSession, d: str) -> DataFrame:
    """Size and reach of the covering sets of the written workloads, each with its own tables."""
    number = {name: i for i, name in enumerate(COVER_CASES)}
    sqls = [sql.replace(" from ", f" from w{number[name]}_") for name, (some, _, _) in COVER_CASES.items() for sql in some]
    shapes = rollup.distinct(cut(_shaped(spark, sqls).where("table is not null"), name="cases"))
    got = rollup.cover_rows(shapes).select(F.regexp_extract("sql", " from w([0-9]+)_", 1).cast("int").alias("w"), "anchor_no", "n").groupBy("w").agg(F.count_distinct("anchor_no").cast("int").alias("anchors"), F.sum("n").cast("int").alias("covered"))
    names = spark.createDataFrame([(i, n) for n, i in number.items()], "w int, workload string")
    return names.join(got, "w", "left").select("workload", F.coalesce("anchors", F.lit(0)).alias("anchors"), F.coalesce("covered", F.lit(0)).alias("covered"))
