"""Session settings and the shared-folder helpers every operator uses."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings under which the operators were written; all are ordinary Spark settings and may be overridden.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_shipped: set[str] = set()


def session(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests, the benchmark and local work."""
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra
    return SparkSession.builder.master(master).appName("spanloom").config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spanloom-")) / "spanloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and all tasks run on this machine, one of our own; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/spanloom-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(_remove, spark, at)
    return at


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        pass


def cut(df: DataFrame, *, name: str = "cut") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    The written table ends the lineage: a lost executor costs a re-read, never a recomputation of an
    iterative plan. A table no later step reads is dropped by :func:`release`, the others when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanloom_path = path  # type: ignore[attr-defined]
    return out


def release(*tables: DataFrame | None) -> None:
    """Remove tables :func:`cut` wrote that nothing reads any more (those of the earlier rounds of an iteration)."""
    for t in tables:
        path = getattr(t, "_spanloom_path", None)
        if path:
            _remove(t.sparkSession, path)


def tasks(spark: SparkSession) -> int:
    """How many reduce tasks the session plans for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, a single file or a folder of part files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
