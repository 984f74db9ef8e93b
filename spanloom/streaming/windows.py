"""The same measures over a stream of spans or log files (an extension: batch results are the reference).

Resume windows are session windows with the suspend time as gap; late rows are taken up to the watermark. All functions
also work on a batch DataFrame, where the watermark has no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.billing import Billing


def read_span_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON-lines span files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def resume_windows(spans: DataFrame, by: str, model: Billing = Billing(), late: str = "10 minutes", time: str = "ts", seconds: str = "exec_s") -> DataFrame:
    """Resume windows per ``by``: ``by, start, end, spans, productive_s, billed_s``; a span's own duration extends the gap."""
    gap = F.concat((F.col(seconds) * 1000 + model.suspend_s * 1000).cast("long").cast("string"), F.lit(" milliseconds"))
    s = spans.withWatermark(time, late).groupBy(F.session_window(F.col(time), gap).alias("_window"), by).agg(F.count(F.lit(1)).alias("spans"), F.sum(seconds).alias("productive_s"))
    length = (F.unix_micros(F.col("_window.end").cast("timestamp")) - F.unix_micros(F.col("_window.start").cast("timestamp"))) / 1e6
    return s.select(by, F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), "spans", "productive_s", F.greatest(F.lit(model.minimum_s), length).alias("billed_s"))


def redundancy_by_hour(spans: DataFrame, fingerprint: str = "exact", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Statements and approximate distinct statements per hour; state is a sketch an hour, not the statements."""
    return spans.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("_window")).agg(F.count(F.lit(1)).alias("queries"), F.approx_count_distinct(fingerprint, 0.02).alias("distinct_queries")).select(F.col("_window.start").alias("hour"), "queries", "distinct_queries")


def credits_as_they_come(spans: DataFrame, credits: DataFrame, within: str = "3 hours") -> DataFrame:
    """Spans joined to credits that may be attributed later, at most ``within`` after the span; unmatched spans come out then."""
    s, c = spans.withWatermark("ts", within), credits.withWatermark("attributed_at", within).withColumnRenamed("query_id", "_q")
    return s.join(c, (F.col("query_id") == F.col("_q")) & (F.col("attributed_at") >= F.col("ts")) & (F.col("attributed_at") <= F.col("ts") + F.expr(f"interval {within}")), "left_outer").drop("_q")


def write_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run what is there now into parquet, with exactly-once file output."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
