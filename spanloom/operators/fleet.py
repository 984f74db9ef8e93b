"""Redundancy ratios: of a fleet by cluster, of whole statements, of sub-expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def selects(fleet: DataFrame) -> DataFrame:
    """SELECTs with a fingerprint."""
    return fleet.where((F.lower("query_type") == "select") & F.col("feature_fingerprint").isNotNull())


def redundancy(fleet: DataFrame, cluster: str = "instance_id", fingerprint: str = "feature_fingerprint", at_least: int = 100) -> DataFrame:
    """``1 - distinct / all`` of every cluster with at least so many rows.

    Rows are first counted by (cluster, fingerprint), so a cluster with most of the rows is spread over all tasks.
    """
    pairs = fleet.groupBy(cluster, fingerprint).agg(F.count(F.lit(1)).alias("n"))
    g = pairs.groupBy(cluster).agg(F.sum("n").alias("queries"), F.count(fingerprint).alias("distinct_queries")).where(F.col("queries") >= at_least)
    return g.withColumn("redundancy", 1 - F.col("distinct_queries") / F.col("queries"))


def summary(per_cluster: DataFrame, high: float = 0.8) -> DataFrame:
    """Clusters, median, quartiles (discrete), extremes and the share at or above ``high``, in per cent."""
    p = lambda x: F.round(100 * x, 1)
    r = F.col("redundancy")
    return per_cluster.agg(
        F.count(F.lit(1)).alias("clusters"), p(F.median(r)).alias("median_pct"), p(F.expr("percentile_disc(0.25) within group (order by redundancy)")).alias("p25_pct"),
        p(F.expr("percentile_disc(0.75) within group (order by redundancy)")).alias("p75_pct"), p(F.min(r)).alias("min_pct"), p(F.max(r)).alias("max_pct"),
        p(F.avg(F.when(r >= high, 1.0).otherwise(0.0))).alias("high_pct"))


def distinct_ratio(df: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """Total, distinct and their ratio (1 for nothing) of each key column; nulls are left out."""
    aggs = []
    for k in keys:
        total, distinct = F.count(k), F.count_distinct(k)
        aggs += [total.alias(f"{k}_total"), distinct.alias(f"{k}_distinct"), F.when(total > 0, distinct / total).otherwise(1.0).alias(f"{k}_ratio")]
    return df.groupBy(*by).agg(*aggs)


def verdict(ratio: float) -> str:
    """What a distinct share says about repeated attempts."""
    return "reproduces" if ratio <= 0.20 else "partially reproduces" if ratio <= 0.40 else "does not reproduce"
