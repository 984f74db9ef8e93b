"""The warehouse's own log as statements and spans (server prefix ``'%m [%p] '``).

A statement runs over its continuation lines. Its duration is a later ``duration:`` line of the same process, matched in
one of two ways: ``slot`` keeps one pending record for the whole log (a statement loses its duration when another
process writes in between), ``per_pid`` keeps one per process. Logs are cut into pieces by range of (log, line); windows run
within a piece, and what a piece hands on to the next is one row a piece, so the largest log is spread over all tasks.

Defined results: rows without log or line number are ignored; repeated lines count once; continuation lines before any
statement belong to none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import context, fingerprint
from spanloom.operators.pieces import following, last_known, pieces
from spanloom.session import ship

#: Fixed value: the layout of a line.
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) (\S+) \[(\d+)\] (LOG|ERROR|STATEMENT|HINT|WARNING|DETAIL|FATAL):  (.*)$"


LINES = "log_id string, line_no long, line string"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines numbered within their split: the byte a split begins at and the place in it rise with the place in the file."""
    block, at = None, 0
    for b in batches:
        file, start = b.column("file").to_pylist(), b.column("start").to_numpy()
        edges = [i for i in range(b.num_rows) if i == 0 or file[i] != file[i - 1] or start[i] != start[i - 1]] + [b.num_rows]
        number = np.empty(b.num_rows, np.int64)
        for lo, hi in zip(edges, edges[1:]):
            if (file[lo], start[lo]) != block:
                block, at = (file[lo], start[lo]), 0
            number[lo:hi] = start[lo] + at + 1 + np.arange(hi - lo)
            at += hi - lo
        yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(number), b.column("value")], ["log_id", "line_no", "line"])


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Log files as ``log_id, line_no, line``. Large files are read in splits; line numbers rise in the order of the lines, from 1 in each file, with gaps between splits."""
    text = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    ship(spark)
    return text.mapInArrow(_numbered, LINES)


def records(lines: DataFrame) -> DataFrame:
    """Every line with its kind: ``statement``, ``duration``, ``other`` or ``more`` (a continuation)."""
    one = lines.where("log_id is not null and line_no is not null").groupBy("log_id", "line_no").agg(F.min("line").alias("line"))
    hit = F.col("line").rlike(LINE)
    rest = F.regexp_extract("line", LINE, 5)
    kind = F.when(~F.coalesce(hit, F.lit(False)), "more").when(rest.startswith("statement: "), "statement").when(rest.rlike(r"^duration: [0-9.]+ ms"), "duration").otherwise("other")
    return one.select("log_id", "line_no", "line", kind.alias("kind"),
                      F.when(hit, F.try_to_timestamp(F.regexp_extract("line", LINE, 1))).alias("ts"),
                      F.when(hit, F.regexp_extract("line", LINE, 3)).alias("pid"), F.when(hit, F.regexp_extract("line", LINE, 4)).alias("level"), rest.alias("rest"))


def statements(lines: DataFrame, pairing: str = "slot") -> DataFrame:
    """``log_id, line_no, ts, pid, sql, duration_ms`` of every statement."""
    if pairing not in ("slot", "per_pid"):
        raise ValueError("pairing must be slot or per_pid")
    r = pieces(records(lines), ["log_id"], ["line_no"], "log")  # read several times
    head = r.where("kind <> 'more'")
    if pairing == "slot":
        head = last_known(head, ["log_id"], "line_no", "_before", F.when(F.col("kind").isin("statement", "other"), F.struct("kind", "pid")), -1)
        head, by = head.where("kind <> 'duration' or (_before is not null and _before.kind = 'statement' and _before.pid = pid)").drop("_before"), ["log_id"]
    else:
        by = ["log_id", "pid"]
    timed = following(head, by, "line_no", "_n", F.struct("kind", "rest")).where("kind = 'statement'")
    ms = F.when(F.col("_n.kind") == "duration", F.regexp_extract("_n.rest", r"^duration: ([0-9.]+) ms", 1).try_cast("double"))
    timed = timed.withColumn("duration_ms", ms)
    # continuation lines belong to the last record, if that is a statement (a matched or foreign duration line ends it, too)
    owned = last_known(r, ["log_id"], "line_no", "_o", F.when(F.col("kind") != "more", F.struct("kind", "line_no")))
    more = owned.where("kind = 'more' and _o.kind = 'statement'").groupBy("log_id", F.col("_o.line_no").alias("line_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("line", F.lit("")).alias("line")))), lambda x: x["line"]), "\n").alias("_more"))
    first = F.substring(F.col("rest"), 12, 1 << 30)
    return timed.join(more, ["log_id", "line_no"], "left").select(
        "log_id", "line_no", "ts", "pid", F.when(F.col("_more").isNotNull(), F.concat(first, F.lit("\n"), F.col("_more"))).otherwise(first).alias("sql"), "duration_ms")


def spans(stmts: DataFrame, strict: bool = False) -> DataFrame:
    """Tagged statements as spans, with the first two fingerprints; untagged ones are left out."""
    c = stmts.withColumn("_c", context.parse(F.col("sql"), strict)).where("_c is not null and _c.trace_id is not null")
    bare = context.strip(F.col("sql"))
    return c.select("log_id", "line_no", "_c.*", bare.alias("sql_text"), F.unix_millis("ts").alias("start_ms"), F.coalesce("duration_ms", F.lit(0.0)).alias("exec_ms")).withColumns(
        {"exact": fingerprint.exact_hash(F.col("sql_text")), "ast": fingerprint.normalized_hash(F.col("sql_text"))})


def in_order(spans: DataFrame) -> DataFrame:
    """Spans by their start, ties in the order of the log."""
    return spans.orderBy("start_ms", "log_id", "line_no")


EVENTS = ("trace_id string, span_id string, parent_span_id string, label string, speculation_class string, span_intent string, attempt_n int, retry_of string, "
          "result_hash string, rows int, client_ms double, values array<string>, question string, error string, snowflake_query_id string, used_downstream boolean, "
          "grounded boolean, uniquely_grounded boolean, evidence array<string>")


def read_events(spark: SparkSession, paths: Iterable[str], missing_ok: bool = True) -> DataFrame:
    """Event files, one JSON object a line; malformed lines fail. Files that do not exist are skipped if ``missing_ok``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if not missing_ok or jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    return spark.read.schema(EVENTS).json(there, mode="FAILFAST") if there else spark.createDataFrame([], EVENTS)


def write_events(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def read_answer(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole answers: ``path, text``."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_fleet(spark: SparkSession, *paths: str) -> DataFrame:
    """A fleet trace over any number of parquet parts."""
    return spark.read.parquet(*paths)


# --- generated tables ----------------------------------------------------------------------------------------------

#: Fixed values of the demonstration warehouse.
REGIONS, CHANNELS = ("AMER", "EMEA", "APAC"), ("paid_search", "organic", "partner", "email")


def warehouse_orders(spark: SparkSession, per_cell: int = 6000, first: str = "2026-06-01", last: str = "2026-07-31", anomaly: str = "2026-07-12", seed: int = 7) -> DataFrame:
    """Days x regions x channels x ``per_cell`` orders; amounts collapse for one region and channel from the anomaly on."""
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}')) as order_date")
    cell = days.crossJoin(spark.createDataFrame([(r,) for r in REGIONS], "region string")).crossJoin(spark.createDataFrame([(c,) for c in CHANNELS], "channel string"))
    rows = cell.crossJoin(spark.range(per_cell).withColumnRenamed("id", "n"))
    odd = (F.col("region") == "EMEA") & (F.col("channel") == "paid_search") & (F.col("order_date") >= anomaly)
    key = F.xxhash64("order_date", "region", "channel", "n", F.lit(seed))
    share = F.pmod(key, F.lit(1_000_000)) / 1e6
    low, wide = F.when(odd, 10.0).otherwise(40.0), F.when(odd, 30.0).otherwise(220.0)
    return rows.select(F.abs(F.xxhash64("order_date", "region", "channel", "n")).alias("order_id"), "order_date", "region", "channel",
                       F.pmod(F.xxhash64(key), F.lit(20_000)).cast("int").alias("customer_id"), (low + wide * share).cast("decimal(10,2)").alias("amount"))


def warehouse_refunds(orders: DataFrame, share: float = 0.002, seed: int = 11) -> DataFrame:
    """A refund of half the amount, five days later, for a hashed share of the orders."""
    chosen = F.pmod(F.xxhash64("order_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return orders.where(chosen).select(F.abs(F.xxhash64("order_id", F.lit(seed))).alias("refund_id"), "order_id", F.date_add("order_date", 5).alias("refund_date"), (F.col("amount") / 2).cast("decimal(10,2)").alias("amount"))


def decoys(spark: SparkSession, tables: int = 120, rows: int = 200, prefix: str = "decoy_") -> list[str]:
    """The views a wide schema is padded with; their names."""
    names = [f"{prefix}{n:03d}" for n in range(1, tables + 1)]
    for n, name in enumerate(names, 1):
        decoy(spark, n, rows).createOrReplaceTempView(name)
    return names


def decoy(spark: SparkSession, number: int, rows: int = 200) -> DataFrame:
    """One of the tables a wide schema is padded with."""
    h = F.xxhash64("id", F.lit(number))
    return spark.range(1, rows + 1).select("id", F.pmod(h, F.lit(5000)).cast("int").alias("entity_id"), F.date_add(F.lit("2026-06-01").cast("date"), F.pmod(h, F.lit(60)).cast("int")).alias("event_date"),
                                           (F.pmod(h, F.lit(100_000)) / 100).cast("decimal(10,2)").alias("amount"), F.element_at(F.array(*map(F.lit, ("ok", "pending", "failed"))), (F.pmod(h, F.lit(3)) + 1).cast("int")).alias("status"), F.lit("filler").alias("note"))
