"""Writers: events, verified events, summaries, tables; and the catalog as tables."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def write_verified(df: DataFrame, path: str, read_from: str | None = None) -> None:
    """Verified events beside their source; writing over what is being read is refused."""
    if read_from is not None and os.path.normpath(path) == os.path.normpath(read_from):
        raise ValueError("verified events go to a new path")
    df.write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A summary of a row or a few as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_table(df: DataFrame, name: str, partition_by: list[str] | None = None, bucket_by: tuple[int, str] | None = None) -> None:
    """A managed parquet table with statistics; partitions and buckets stand in for indexes."""
    w = df.write.mode("overwrite").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        w = w.bucketBy(*bucket_by)
    w.saveAsTable(name)
    df.sparkSession.sql(f"analyze table {name} compute statistics")


def catalog_tables(spark: SparkSession) -> DataFrame:
    """The session's tables and views: ``table_schema, table_name, table_type``."""
    rows = [(".".join(t.namespace or []), t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def catalog_columns(spark: SparkSession) -> DataFrame:
    """Their columns: ``table_name, column_name, data_type, ordinal_position``."""
    rows = [(t.name, c.name, c.dataType, i) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal_position int")


def load_env(path: str, into: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines of a file, one layer of quotes removed; names that are already set keep their value."""
    env = os.environ if into is None else into
    p = Path(path)
    for line in p.read_text().splitlines() if p.exists() else ():
        key, sign, value = line.strip().removeprefix("export ").partition("=")
        if not sign or key.startswith("#") or not key.strip():
            continue
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        env.setdefault(key.strip(), value)
    return dict(env)
