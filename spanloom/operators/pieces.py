"""Running values over ordered groups of any size: a group is cut into pieces, and a piece hands a row on to the next.

A window over a whole group puts the group into one task. Here rows are range-partitioned by (group, order), so a group
with a third of all rows spans many partitions; windows run within (group, piece), and what all earlier pieces of a group
come to is computed from one row a piece. A null group is a group of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spanloom.session import cut


def pieces(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "pieces") -> DataFrame:
    """``df`` written once in ranges of (group, order), with its ``_piece``."""
    return cut(df.repartitionByRange(*by, *order).withColumn("_piece", F.spark_partition_id()), name=name)


def within(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The window over a group's rows in one piece."""
    return Window.partitionBy(*by, "_piece").orderBy(*order)


def _with(r: DataFrame, t: DataFrame, by: Sequence[str]) -> DataFrame:
    """``r`` joined to a row a piece ``t`` (``by, _piece, _v``)."""
    t = t.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_piece").alias("_p"), "_v")
    on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)] + [F.col("_piece") == F.col("_p")]
    return r.join(t, on, "left").drop(*[f"_g{i}" for i in range(len(by))], "_p")


def running(
    r: DataFrame, by: Sequence[str], order: Sequence[str], name: str, value: Column, fold: Callable[[Column], Column],
    join: Callable[[Column, Column], Column], upto: int = 0,
) -> DataFrame:
    """``r`` with ``fold`` (max, sum) of ``value`` over the rows of its group up to ``upto`` (0: this one, -1: the one before), null if there are none.

    join puts what earlier pieces come to and what this one comes to together; both are there.
    """
    ends = r.groupBy(*by, "_piece").agg(fold(value).alias("_v"))  # a row a piece and group
    before = ends.withColumn("_v", fold(F.col("_v")).over(Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)))
    here = fold(value).over(within(by, order).rowsBetween(Window.unboundedPreceding, upto))
    x = _with(r.withColumn(name, here), before, by)
    both = join(F.col("_v"), F.col(name))
    return x.withColumn(name, F.when(F.col("_v").isNull(), F.col(name)).when(F.col(name).isNull(), F.col("_v")).otherwise(both)).drop("_v")


def last_known(r: DataFrame, by: Sequence[str], order: str, name: str, value: Column, upto: int = 0) -> DataFrame:
    """``r`` with the last ``value`` that is not null of the rows up to ``upto``."""
    ends = r.groupBy(*by, "_piece").agg(F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias("_v"))
    before = ends.withColumn("_v", F.last("_v", True).over(Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)))
    here = F.last(value, True).over(within(by, [order]).rowsBetween(Window.unboundedPreceding, upto))
    return _with(r.withColumn(name, here), before, by).withColumn(name, F.coalesce(name, "_v")).drop("_v")


def following(r: DataFrame, by: Sequence[str], order: str, name: str, value: Column) -> DataFrame:
    """``r`` with the ``value`` (a struct) of the next row."""
    heads = r.groupBy(*by, "_piece").agg(F.min_by(value, order).alias("_v"))
    after = heads.withColumn("_v", F.lead("_v").over(Window.partitionBy(*by).orderBy("_piece")))
    return _with(r.withColumn(name, F.lead(value).over(within(by, [order]))), after, by).withColumn(name, F.coalesce(name, "_v")).drop("_v")
