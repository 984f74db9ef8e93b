"""Measured cost: tagged query history joined to attributed credits. No ratio is given when no credits are known yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.context import parse_tag


def tagged(history: DataFrame, hours: float | None = None, preflight: str = "preflight") -> DataFrame:
    """Rows whose tag names a trace, preflight rows left out; optionally of the trailing hours only."""
    h = history.where(F.col("query_tag").contains('"t":') & ~F.col("query_tag").contains(preflight))
    if hours is not None:
        h = h.where(F.col("start_time") >= F.current_timestamp() - F.make_dt_interval(hours=F.lit(int(hours))))
    return h.withColumn("_t", parse_tag(F.col("query_tag"))).where("_t is not null").select("*", F.col("_t.trace_id").alias("trace_id")).drop("_t")


#: Fixed value: rows a recent-history source hands out at most.
RECENT_ROWS = 10_000


def recent(history: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """What a near-real-time history source would hand out: its n newest rows."""
    return newest(history, n)


def newest(history: DataFrame, n: int = 500) -> DataFrame:
    """The n newest rows (a report of fixed length)."""
    return history.orderBy(F.desc("start_time"), "query_id").limit(n)


def per_trace(history: DataFrame, attribution: DataFrame) -> DataFrame:
    """Credits, seconds, bytes and queries of each trace; queries without credits yet count as such."""
    x = history.join(attribution, "query_id", "left")
    return x.groupBy("trace_id").agg(F.sum("credits_attributed_compute").alias("credits"), F.sum("total_elapsed_time").alias("elapsed_ms"), F.sum("bytes_scanned").alias("bytes_scanned"),
                                     F.count(F.lit(1)).alias("queries"), F.count("credits_attributed_compute").alias("attributed"))


def summary(traces: DataFrame, dollars_per_credit: float = 3.0, modelled: float = 0.073) -> DataFrame:
    """Cost per task and its ratio to a modelled one; both null while credits are zero or unknown, with the reason."""
    t = traces.agg(F.count(F.lit(1)).alias("traces"), F.coalesce(F.sum("credits"), F.lit(0.0)).alias("credits"), F.sum("queries").alias("queries"), F.sum("attributed").alias("attributed"))
    cost = F.when(F.col("credits") > 0, F.col("credits") * dollars_per_credit / F.greatest(F.col("traces"), F.lit(1)))
    return t.withColumn("cost_per_task", cost).withColumn("ratio", F.col("cost_per_task") / modelled).withColumn("reason", F.when(F.col("credits") <= 0, "no credits attributed yet"))
