"""Per-key results where a few keys hold most rows: fragment-replicate by estimated load.

1. Load: rows per key, counted with map-side combine (each task sends one row a key); for per-key results the rows are
   the pairs of key and item with their counts, so neither a hot pair nor null items of a heavy key weigh on one task.
2. Plan: keys above a tenth of a task's fair share are split into shards of at most half a share, in proportion to their
   load, and packed onto the least loaded tasks (longest first); all other keys stay where their hash puts them, and the
   load they bring is the starting load of the bins. The plan has at most ``12 * tasks`` shards, whatever the data.
3. Route: a row goes to its key's shard by the hash of its item, so equal items of a key meet in one shard and
   distinct counts of the shards add up. Rows are sent straight to the planned task.
4. A matching side is replicated only to the planned tasks of its key's shards (:func:`fragment_replicate_join`).

Defined results: a null key is one key of its own; null items count as rows, not as distinct items; no rows give no
keys. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut, tasks

#: A key is placed by the plan when it holds more than this part of a task's fair share; the most of a share one shard holds.
HEAVY, SHARD = 0.1, 0.5


def pack(heavy: list[tuple[object, int]], light: list[int], capacity: float) -> dict[object, list[int]]:
    """Tasks of the shards of every heavy key.

    heavy: (key, rows); light: rows per task that other keys bring. Longest shard first onto the least loaded task.
    """
    shards = []
    for key, n in heavy:
        k = max(1, math.ceil(n / capacity))
        shards += [(n / k, repr(key), j, key) for j in range(k)]
    bins = [(load, i) for i, load in enumerate(light)]
    heapq.heapify(bins)
    out: dict[object, list[int]] = {key: [] for key, _ in heavy}
    for n, _, _, key in sorted(shards, key=lambda s: (-s[0], s[1], s[2])):
        load, i = heapq.heappop(bins)
        out[key].append(i)
        heapq.heappush(bins, (load + n, i))
    return out


def plan(df: DataFrame, key: str, n_tasks: int) -> tuple[DataFrame, int]:
    """The placement table ``_key, _shards, _places`` of the heavy keys (at most tasks / HEAVY rows), and all rows' count."""
    spark = df.sparkSession
    load = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    load = cut(load.withColumn("_home", F.pmod(F.xxhash64("_key"), F.lit(n_tasks)).cast("int")), name="load")  # a row a key, read three times
    total = load.agg(F.sum("n")).first()[0] or 0
    capacity = max(1.0, total / n_tasks)
    big = load.where(F.col("n") > HEAVY * capacity)  # at most n_tasks / HEAVY keys can hold so much
    heavy = sorted(((r["_key"], r["n"]) for r in big.collect()), key=lambda x: (-x[1], str(x[0])))
    light = [0] * n_tasks
    for r in load.where(F.col("n") <= HEAVY * capacity).groupBy("_home").agg(F.sum("n").alias("n")).collect():
        light[r["_home"]] = r["n"]
    placed = pack(heavy, light, capacity * SHARD)
    kind = df.schema[key].dataType.simpleString()
    rows = [(k, len(p), p) for k, p in placed.items()]
    return spark.createDataFrame(rows, f"_key {kind}, _shards int, _places array<int>"), total


def assign(df: DataFrame, key: str, item: str, placement: DataFrame, n_tasks: int) -> DataFrame:
    """Adds ``_shard`` and ``_task``, where the plan puts a row."""
    at = F.broadcast(placement)  # at most n_tasks / HEAVY rows, see plan()
    shard = F.coalesce(F.pmod(F.xxhash64(F.lit("shard"), F.col(item)), F.col("_shards")), F.lit(0)).cast("int")
    return (
        df.join(at, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_shard", shard)
        .withColumn("_task", F.coalesce(F.element_at("_places", F.col("_shard") + 1), F.pmod(F.xxhash64(F.col(key)), F.lit(n_tasks)).cast("int")))
        .drop("_key", "_shards", "_places")
    )


def route(df: DataFrame, key: str, item: str, placement: DataFrame, n_tasks: int) -> DataFrame:
    """Sends every row to its task."""
    return assign(df, key, item, placement, n_tasks).repartitionById(n_tasks, "_task")


def per_key(df: DataFrame, key: str, item: str, n_tasks: int | None = None) -> DataFrame:
    """Rows, distinct items and redundancy (1 - distinct items / rows with an item) of every key; ``total``: rows of all keys."""
    n = n_tasks or 4 * tasks(df.sparkSession)
    # counted map-side: a hot pair of key and item is one row a task, then one row
    pairs = cut(df.select(F.col(key).alias("k"), F.col(item).alias("i")).groupBy("k", "i").agg(F.count(F.lit(1)).alias("n")), name="pairs")  # read three times
    total = pairs.agg(F.sum("n")).first()[0] or 0
    placement, _ = plan(pairs, "k", n)
    routed = route(pairs, "k", "i", placement, n)
    # the routing already brought a task's rows of a key together: no exchange before the last, small one
    shards = routed.groupBy("_task", "k").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("i").isNotNull(), F.col("n")).otherwise(0)).alias("with_item"), F.count("i").alias("d"))
    return shards.groupBy("k").agg(F.sum("n").alias("queries"), F.sum("with_item").alias("with_item"), F.sum("d").alias("distinct_items")).select(
        F.col("k").alias(key), "queries", "distinct_items",
        F.when(F.col("with_item") > 0, 1 - F.col("distinct_items") / F.col("with_item")).alias("redundancy"), F.lit(total).cast("long").alias("total"))


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, spread: str, n_tasks: int | None = None, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``key``; heavy keys of ``left`` are cut into shards by the hash of ``spread``.

    ``right`` is copied once per shard of a heavy key and not at all for other keys. how: inner or left.
    Columns of ``right`` that ``left`` also has get the suffix ``_right``.
    """
    n = n_tasks or 4 * tasks(left.sparkSession)
    placement, _ = plan(left.select(key), key, n)
    at = F.broadcast(placement.toDF("__fr_key", "__fr_shards", "__fr_places"))  # at most n / HEAVY rows, see plan()

    def home(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    # a row without a spread value is spread by all it holds; a null key meets nothing, so its rows may lie anywhere
    plain = [f.name for f in left.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    by = F.xxhash64(F.lit("shard"), F.col(spread), F.when(F.col(spread).isNull(), F.xxhash64(*plain)))
    l = left.join(at, F.col(key) == F.col("__fr_key"), "left").withColumn(
        "__fr_shard", F.coalesce(F.pmod(by, F.col("__fr_shards")), F.lit(0)).cast("int")).withColumn(
        "__fr_task", F.when(F.col(key).isNull(), home(by)).otherwise(F.coalesce(F.element_at("__fr_places", F.col("__fr_shard") + 1), home(F.col(key))))).drop("__fr_key", "__fr_shards", "__fr_places").repartitionById(n, "__fr_task")
    r = right.select(F.col(key).alias("__fr_rkey"), *[F.col(c).alias(c + "_right" if c in left.columns else c) for c in right.columns if c != key])
    r = r.where("__fr_rkey is not null").join(at, F.col("__fr_rkey") == F.col("__fr_key"), "left").withColumn(
        "__fr_rshard", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__fr_shards"), F.lit(1)) - 1))).withColumn(
        "__fr_rtask", F.coalesce(F.element_at("__fr_places", F.col("__fr_rshard") + 1), home(F.col("__fr_rkey").try_cast(left.schema[key].dataType)))).drop("__fr_key", "__fr_shards", "__fr_places").repartitionById(n, "__fr_rtask")
    same = (F.col("__fr_task") == F.col("__fr_rtask")) & (F.col(key) == F.col("__fr_rkey")) & (F.col("__fr_shard") == F.col("__fr_rshard"))
    return l.join(r, same, how).drop("__fr_rkey", "__fr_rshard", "__fr_rtask", "__fr_shard", "__fr_task")
