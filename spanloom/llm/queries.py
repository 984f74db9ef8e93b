"""The registered queries of the subpackage: name -> query, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, canonical, expsketch, heavyhitters, langid, mixing
from spanloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f
    return add


# --- problem 2: duplicates hidden by formatting --------------------------------------------------------------------

@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every copy with the smallest row id of its group."""
    return canonical.runs(table(spark, d, "spans")).where("row_id <> first_row_id").select("first_row_id", F.col("row_id").alias("copy_row_id"))


@query()
def p2_statements(spark: SparkSession, d: str) -> DataFrame:
    """One record a statement with its number of copies."""
    return canonical.representatives(table(spark, d, "spans"))


# --- problem 4: distinct counts ------------------------------------------------------------------------------------

@query()
def p4_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct fingerprints and instances per arrival day, group and combination of groups."""
    r = table(spark, d, "r").select(F.to_date("arrival_ts").alias("day"), "instance_id", F.lower("query_type").alias("query_type"), "database_id", "cluster_size", "feature_fingerprint")
    return expsketch.distinct_counts(r, "day", ["feature_fingerprint", "instance_id"], ["instance_id", "query_type", "database_id", "cluster_size"])


@query("""
with x as (select cast(arrival_ts as date) as day, instance_id, lower(query_type) as query_type, database_id, cluster_size, feature_fingerprint from r),
f as (select day, array_to_string(list_filter([case when grouping(instance_id) = 0 then 'instance_id' end, case when grouping(query_type) = 0 then 'query_type' end, case when grouping(database_id) = 0 then 'database_id' end, case when grouping(cluster_size) = 0 then 'cluster_size' end], lambda c: c is not null), ',') as "grouping",
             'feature_fingerprint' as item, count(distinct feature_fingerprint) as n from x group by day, cube (instance_id, query_type, database_id, cluster_size)),
i as (select day, array_to_string(list_filter([case when grouping(query_type) = 0 then 'query_type' end, case when grouping(database_id) = 0 then 'database_id' end, case when grouping(cluster_size) = 0 then 'cluster_size' end], lambda c: c is not null), ',') as "grouping",
             'instance_id' as item, count(distinct instance_id) as n from x group by day, cube (query_type, database_id, cluster_size))
select "grouping", item, count(*) as cells, count(*) filter (n > 512) as from_registers, sum(case when n <= 512 then n else 0 end)::double as exact_total from (select * from f union all select * from i) where n > 0 group by 1, 2""")
def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    """Of each set of groups: its cells, how many are counted from registers, and the total of the others, which are exact."""
    c = p4_distinct(spark, d).groupBy("grouping", "item")
    return c.agg(F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("exact")).alias("from_registers"), F.sum(F.when(F.col("exact"), F.col("estimate")).otherwise(0.0)).alias("exact_total"))


# --- problem 6: most frequent items --------------------------------------------------------------------------------

@query("""
select feature_fingerprint from r where feature_fingerprint is not null group by feature_fingerprint
having count(*) >= 0.005 * (select count(feature_fingerprint) from r)""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints in at least 0.5 % of the rows that have one."""
    return heavyhitters.heavy_hitters(table(spark, d, "r"), "feature_fingerprint", 0.005).select(F.col("item").alias("feature_fingerprint"))


@query("""
select feature_fingerprint, count(*) as n from r where feature_fingerprint is not null group by feature_fingerprint
having count(*) >= 0.002 * (select count(feature_fingerprint) from r)""")
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return heavyhitters.heavy_hitters(table(spark, d, "r"), "feature_fingerprint", 0.002).select(F.col("item").alias("feature_fingerprint"), "n")


# --- problem 7: encoding -------------------------------------------------------------------------------------------

@query()
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


@query("select doc_id, md5(coalesce(text, '')) as digest, text is null or text = '' as without_ids from documents")
def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The texts the ids of all documents stand for, as digests."""
    back = bpe.decode(bpe.encode(table(spark, d, "documents")))
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), (F.size("ids") == 0).alias("without_ids"))


# --- problem 8: mixing ---------------------------------------------------------------------------------------------

def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple]]:
    targets = table(spark, d, "mix_targets")
    return mixing.mix(mixing.sized(table(spark, d, "documents"), table(spark, d, "agents"), targets), targets)


@query()
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document occurs in each mix."""
    return _mixed(spark, d)[0]


@query()
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d))


@query("select mix_id, source, true as within_cap, true as share_met from mix_targets where mix_id is not null and source is not null")
def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """Of each source of a mix: no document beyond ``max_repeats``, and its tokens met within a hundredth or one document; out of reach, all there is used."""
    s = mixing.shares(*_mixed(spark, d))
    near = F.abs(F.col("actual_tokens") - F.col("target_tokens")) <= F.greatest(0.01 * F.col("target_tokens"), F.col("largest_document"))
    met = F.when(F.col("reachable"), near).otherwise(F.col("actual_tokens") == F.col("most_tokens"))
    return s.select("mix_id", "source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), met.alias("share_met"))


# --- problem 9: languages ------------------------------------------------------------------------------------------

def _segments(spark: SparkSession, d: str, label: Column | None = None) -> DataFrame:
    documents = table(spark, d, "documents")
    return langid.segments(documents, langid.fit(table(spark, d, "lang_samples"), documents), label=label)


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the documents whose label is missing or wrong or whose text is in several languages."""
    per = _segments(spark, d, langid.label_column(F.col("lang"))).groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.first("label").alias("label"))  # at most eleven a document
    bad = per.where((F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label")))
    return bad.select("doc_id", F.explode("langs").alias("lang"))


@query()
def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


@query()
def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.languages(_segments(spark, d))
