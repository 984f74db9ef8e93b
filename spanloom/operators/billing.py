"""What keeping a warehouse awake costs: resume windows, idle time, and each span's part of the bill.

Every function works per ``by`` (a warehouse, an agent, a trace). Spans are cut into pieces by range of (key, start), and a piece
hands the latest end and the number of windows on to the next, so one warehouse with most of the spans is spread over all
tasks. Times are milliseconds in, seconds out.

Defined results: rows without start are ignored, a missing duration is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.pieces import pieces, running
from spanloom.session import cut


@dataclass(frozen=True)
class Billing:
    """Fixed values of the billing model, all of them parameters."""
    suspend_s: float = 60.0
    minimum_s: float = 60.0
    credits_per_hour: float = 1.0
    dollars_per_credit: float = 3.0
    tasks_per_day: int = 5000

    def dollars(self, seconds: Column) -> Column:
        return seconds / 3600 * self.credits_per_hour * self.dollars_per_credit


def _beside(x: DataFrame, per: DataFrame, by: Sequence[str]) -> DataFrame:
    """``x`` with the columns of a row a key; a null key meets itself."""
    per = per.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})
    return x.join(per, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]).drop(*[f"_k{i}" for i in range(len(by))])


def intervals(spans: DataFrame, by: Sequence[str], order: str, dilation: float = 1.0) -> DataFrame:
    """Adds ``start_s`` (since the key's first span, stretched by ``dilation``) and ``end_s``."""
    known = cut(spans.where(F.col("start_ms").isNotNull()), name="known")  # read for the first start, the ranges and the pieces
    x = _beside(known, known.groupBy(*by).agg(F.min("start_ms").alias("_first")), by)
    return x.withColumn("start_s", (F.col("start_ms") - F.col("_first")) / 1000.0 * dilation).withColumn("end_s", F.col("start_s") + F.coalesce(F.col("exec_ms"), F.lit(0.0)) / 1000.0).drop("_first")


def windows_of(spans: DataFrame, by: Sequence[str], order: str, model: Billing = Billing(), dilation: float = 1.0) -> DataFrame:
    """Every span with ``window_no``: a new window begins when the warehouse was idle for longer than the suspend time."""
    return _windows_of(spans, by, order, model, dilation).drop("_last_end", "_piece")


def _windows_of(spans: DataFrame, by: Sequence[str], order: str, model: Billing, dilation: float) -> DataFrame:
    """:func:`windows_of` with ``_last_end``, the latest end of the spans before; written once."""
    at = ["start_s", order]
    x = pieces(intervals(spans, by, order, dilation), by, at, "spans")
    x = running(x, by, at, "_last_end", F.col("end_s"), F.max, F.greatest, -1)
    opens = F.when(F.col("_last_end").isNull() | (F.col("start_s") > F.col("_last_end") + model.suspend_s), 1).otherwise(0)
    x = cut(x.withColumn("_opens", opens), name="opens")
    return running(x, by, at, "window_no", F.col("_opens"), F.sum, lambda a, b: a + b).drop("_opens")


def windows(spans: DataFrame, by: Sequence[str], order: str, model: Billing = Billing(), dilation: float = 1.0) -> DataFrame:
    """One row a resume window, with what it bills."""
    g = windows_of(_narrow(spans, by, order), by, order, model, dilation).groupBy(*by, "window_no").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("spans"), F.sum(F.col("end_s") - F.col("start_s")).alias("productive_s"))
    return g.withColumn("billed_s", F.greatest(F.lit(model.minimum_s), F.col("end_s") - F.col("start_s") + model.suspend_s))


def bill(spans: DataFrame, by: Sequence[str], order: str, model: Billing = Billing(), dilation: float = 1.0) -> DataFrame:
    """One row a key: windows, billed, productive, overhead, batched, elapsed and busy seconds, dollars.

    elapsed is the end of the span that started last; busy is the union of all intervals, which productive (their sum)
    exceeds when spans overlap.
    """
    return _bill(_windows_of(_narrow(spans, by, order), by, order, model, dilation), by, order, model)


def _narrow(spans: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """What a bill needs of the spans."""
    return spans.select(*dict.fromkeys([*by, order, "start_ms", "exec_ms"]))


def _bill(x: DataFrame, by: Sequence[str], order: str, model: Billing) -> DataFrame:
    x = x.withColumn("_busy", F.greatest(F.col("end_s") - F.greatest(F.col("start_s"), F.coalesce("_last_end", "start_s")), F.lit(0.0)))
    per = x.groupBy(*by, "window_no").agg(F.min("start_s").alias("a"), F.max("end_s").alias("b"), F.sum(F.col("end_s") - F.col("start_s")).alias("p"), F.count(F.lit(1)).alias("n"),
                                          F.sum("_busy").alias("busy"), F.max(F.struct("start_s", order, "end_s")).alias("last"))
    g = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("n").alias("spans"), F.sum(F.greatest(F.lit(model.minimum_s), F.col("b") - F.col("a") + model.suspend_s)).alias("billed_s"),
        F.sum("p").alias("productive_s"), F.sum("busy").alias("busy_s"), F.max("last")["end_s"].alias("elapsed_s"))
    return g.withColumns({"overhead_s": F.col("billed_s") - F.col("productive_s"), "batched_s": F.greatest(F.lit(model.minimum_s), F.col("productive_s") + model.suspend_s),
                          "dollars": model.dollars(F.col("billed_s")), "idle_share": F.when(F.col("billed_s") > 0, 1 - F.col("productive_s") / F.col("billed_s"))})


def attribute(spans: DataFrame, by: Sequence[str], order: str, model: Billing = Billing(), dilation: float = 1.0) -> DataFrame:
    """Every span with its part of the bill: its own seconds and, in proportion, the idle ones (equal parts without any)."""
    x = cut(_windows_of(spans, by, order, model, dilation), name="windows")  # read by the bill and by its parts
    bills = _bill(x, by, order, model).select(*by, F.col("billed_s").alias("_bill"), F.col("productive_s").alias("_prod"), F.col("spans").alias("_n"))
    own = F.col("end_s") - F.col("start_s")
    part = own + F.when(F.col("_prod") > 0, own / F.col("_prod") * (F.col("_bill") - F.col("_prod"))).otherwise((F.col("_bill") - F.col("_prod")) / F.col("_n"))
    return _beside(x, bills, by).withColumn("billed_s", part).withColumn("cost", model.dollars(F.col("billed_s"))).drop("_bill", "_prod", "_n", "_last_end", "_piece")


def extrapolate(cost_per_task: Column, model: Billing = Billing(), days: int = 30) -> Column:
    """What a task's cost comes to over ``days`` of a fleet's tasks."""
    return cost_per_task * model.tasks_per_day * days
