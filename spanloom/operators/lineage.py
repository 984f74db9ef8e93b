"""Spans with what the agent said about them: event join, plan tree, sibling groups, waste.

Defined results: of several events of a span the latest counts; a span without event is not used downstream and has
unknown grounding; ids compare trimmed and in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import intent_label
from spanloom.operators.hierarchy import clean_id, depth_first


def latest_spans(spans: DataFrame) -> DataFrame:
    """One row a span: the latest delivery."""
    k = [clean_id(F.col("trace_id")).alias("trace_key"), clean_id(F.col("span_id")).alias("span_key")]
    s = spans.select(*k, F.struct(*spans.columns).alias("_row"), F.struct("ingested_at", "row_id").alias("_late")).where("trace_key is not null and span_key is not null")
    return s.groupBy("trace_key", "span_key").agg(F.max_by("_row", "_late").alias("_row")).select("trace_key", "span_key", "_row.*")


def latest_events(events: DataFrame) -> DataFrame:
    """One row a span: the event logged last (ties by label, then by result)."""
    e = events.select(clean_id(F.col("trace_id")).alias("trace_key"), clean_id(F.col("span_id")).alias("span_key"),
                      F.struct("label", "result_hash", "row_count", "client_ms", "result_values", "error", "used_downstream", "grounded").alias("_e"), F.struct("logged_at", "label", "result_hash").alias("_late"))
    return e.where("trace_key is not null and span_key is not null").groupBy("trace_key", "span_key").agg(F.max_by("_e", "_late").alias("_e")).select("trace_key", "span_key", "_e.*")


def span_events(spans: DataFrame, events: DataFrame) -> DataFrame:
    """Spans with the fields of their event; without one ``used_downstream`` is false and ``grounded`` null."""
    return latest_spans(spans).join(latest_events(events), ["trace_key", "span_key"], "left").withColumn("used_downstream", F.coalesce("used_downstream", F.lit(False)))


def follow_labels(calls: DataFrame, label: str = "label", follows: str = "follows_from") -> DataFrame:
    """The parent span of calls that name an earlier call's label; an unknown label gives null."""
    known = calls.select(F.col("trace_id").alias("_t"), F.col(label).alias("_l"), F.col("span_id").alias("parent_of")).dropDuplicates(["_t", "_l"])
    return calls.join(known, (F.col("trace_id") == F.col("_t")) & (F.col(follows) == F.col("_l")), "left").drop("_t", "_l").withColumnRenamed("parent_of", "parent_span_id")


def roots(spans: DataFrame) -> DataFrame:
    """Spans without a parent in their trace."""
    s = latest_spans(spans).withColumn("parent_key", clean_id(F.col("parent_span_id")))
    known = s.select("trace_key", F.col("span_key").alias("parent_key"))
    return s.where("parent_key is null").unionByName(s.where("parent_key is not null").join(known, ["trace_key", "parent_key"], "left_anti").select(s.columns))


def plan_tree(spans: DataFrame) -> DataFrame:
    """Spans of trees in depth-first order: ``trace_id, span_id, parent_id, depth, position`` (from 1 within the trace).

    Siblings come in the order of their start, ties by id.
    """
    return depth_first(spans, "start_ms")


def sibling_groups(costed: DataFrame, parent: str = "parent_key", more_than: int = 3) -> DataFrame:
    """Siblings whose intents differ only in day, region or channel, where there are more than ``more_than``."""
    return costed.groupBy("trace_key", parent, intent_label(F.col("span_intent")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")).where(F.col("n") > more_than)


def waste(costed: DataFrame, *by: str, dead_end: str = "(?i)refund") -> DataFrame:
    """Cost of spans no answer used, against all; and of the dead ends among them (by intent)."""
    unused = ~F.col("used_downstream")
    g = costed.groupBy(*by).agg(F.count(F.lit(1)).alias("spans"), F.count_if("used_downstream").alias("cited"), F.sum("cost").alias("cost"),
                                F.sum(F.when(unused, F.col("cost")).otherwise(0.0)).alias("wasted"), F.sum(F.when(unused & F.col("span_intent").rlike(dead_end), F.col("cost")).otherwise(0.0)).alias("dead_end"))
    return g.withColumn("wasted_share", F.when(F.col("cost") > 0, F.col("wasted") / F.col("cost")))
