"""Which rollups answer which aggregates, a small set of rollups that answers most, and answering from a rollup.

Shapes are held as rows ``shape_id, table, measures, groupby, filters, eq_cols`` (:data:`SHAPES`); candidates likewise.
:func:`distinct` folds equal shapes of a table of statements, with their number ``n``. The match of candidates and shapes is
a join on what any match must share, with the whole test (every need of the shape met by an offer of the rollup) after it: the table, the filters that are no
equalities (a rollup cannot add them later), one equality filter of the rollup, and one measure of the shape. Rollups and
shapes that differ in table or such filters never meet, so the greedy choice falls into independent groups and runs in tasks;
the edges of one group have to fit a task.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.sqlplan import Shape
from spanloom.session import cut, ship

SHAPES = "shape_id long, table string, measures array<string>, groupby array<string>, filters array<string>, eq_cols array<string>"
#: Functions whose result follows from a finer grouping by their argument.
BUCKETING = ("date_trunc", "date", "to_char", "extract", "date_part")
ADDITIVE = ("sum", "count", "min", "max")
#: Fixed value: the pattern of an equality on a column.
_EQUAL = r"^([a-z_][a-z0-9_]*)\s*="


def frame(spark: SparkSession, shapes: Iterable[tuple[int, Shape]]) -> DataFrame:
    ship(spark)
    return spark.createDataFrame([(i, s.table, list(s.measures), list(s.groupby), list(s.filters), list(s.eq_cols)) for i, s in shapes], SHAPES)


# --- the test: what a rollup offers against what a query needs -------------------------------------------------------

def offers(measures: Iterable[str], groupby: Iterable[str], filters: Iterable[str]) -> set[str]:
    """Everything the rows of a rollup can stand in for: its additive measures, its dimensions, its filters.

    Averages come from a sum beside a count; a count of distinct values only from a rollup of one row.
    """
    have, dims = set(measures), list(groupby)
    name = {m: m.partition("(")[0] for m in have}
    distinct = {m for m in have if m.startswith("count(distinct ")}
    out = {m for m in have - distinct if name[m] in ADDITIVE} | (set() if dims else distinct)
    if any(name[m] == "count" for m in have - distinct):
        out |= {"avg" + m.removeprefix("sum") for m in have if name[m] == "sum"}
    return {f"measure {m}" for m in out} | {f"dim {d}" for d in dims} | {f"filter {f}" for f in filters}


def needs(measures: Iterable[str], groupby: Iterable[str], filters: Iterable[str]) -> list[list[str]]:
    """What a query needs, each need as the list of offers that meet it.

    A bucket of a dimension is met by the dimension; a filter by itself or, if it is an equality, by its column as a dimension.
    """
    out = [[f"measure {m}"] for m in measures]
    for d in groupby:
        name, bracket, inner = d.partition("(")
        plain = bracket and name in BUCKETING and inner.endswith(")") and ")" not in inner[:-1]
        columns = [x.strip() for x in inner[:-1].split(",")] if plain else []
        out.append([f"dim {x}" for x in [d, *(c for c in columns if not c.startswith("'"))]])
    for f in filters:
        equality = re.match(_EQUAL, f)
        out.append([f"filter {f}", *([f"dim {equality[1]}"] if equality else [])])
    return out


def subsumes(anchor: Shape, query: Shape) -> bool:
    """Whether the query can be answered from the anchor: same table, no filter the query lacks, every need met."""
    have = offers(anchor.measures, anchor.groupby, anchor.filters)
    return anchor.table == query.table and set(anchor.filters) <= set(query.filters) and all(have.intersection(n) for n in needs(query.measures, query.groupby, query.filters))


#: What stands between the strings of a list, and between lists, on the way to Python and back (plain strings travel fastest).
_OF, _LISTS = "\x1f", "\x1e"


def _lists(*columns: pd.Series):
    return zip(*[[x.split(_OF) if x else [] for x in c] for c in columns])


def _offers_series(measures: pd.Series, groupby: pd.Series, filters: pd.Series) -> pd.Series:
    return pd.Series([_OF.join(sorted(offers(*x))) for x in _lists(measures, groupby, filters)], dtype=object)


def _needs_series(measures: pd.Series, groupby: pd.Series, filters: pd.Series) -> pd.Series:
    return pd.Series([_LISTS.join(_OF.join(n) for n in needs(*x)) for x in _lists(measures, groupby, filters)], dtype=object)


def _flat() -> list[Column]:
    return [F.array_join(c, _OF) for c in ("measures", "groupby", "filters")]


def offers_column() -> Column:
    """:func:`offers` of the columns measures, groupby and filters."""
    return F.split(F.pandas_udf(_offers_series, "string")(*_flat()), _OF)


def needs_column() -> Column:
    return F.transform(F.split(F.pandas_udf(_needs_series, "string")(*_flat()), _LISTS), lambda n: F.split(n, _OF))


def subsumes_column(a: str = "a", q: str = "q") -> Column:
    """The test for a joined pair of struct columns that hold ``table, filters, have`` (of the rollup) and ``table, filters, need``."""
    return ((F.col(f"{a}.table") == F.col(f"{q}.table")) & (F.size(F.array_except(F.col(f"{a}.filters"), F.col(f"{q}.filters"))) == 0)
            & F.forall(F.col(f"{q}.need"), lambda n: F.arrays_overlap(n, F.col(f"{a}.have"))))


def candidates(shapes: DataFrame) -> DataFrame:
    """Synthesized rollups: per table the servable measures, by each set of dimensions in use and by all of them."""
    m = shapes.select("table", "shape_id", F.explode("measures").alias("m")).where(~F.col("m").startswith("count(distinct "))
    m = m.select("table", F.when(F.col("m").startswith("avg("), F.concat(F.lit("sum("), F.substring("m", 5, 1 << 20))).otherwise(F.col("m")).alias("m"))
    m = m.unionByName(shapes.select("table", F.lit("count(*)").alias("m"))).groupBy("table").agg(F.array_sort(F.collect_set("m")).alias("measures"))
    dims = shapes.select("table", "shape_id", F.array_sort(F.array_union("groupby", "eq_cols")).alias("groupby"))
    first = shapes.groupBy("table").agg(F.min("shape_id").alias("first"))
    each = dims.groupBy("table", "groupby").agg(F.min("shape_id").alias("at")).withColumn("whole", F.lit(0))
    whole = dims.select("table", F.explode("groupby").alias("d")).groupBy("table").agg(F.array_sort(F.collect_set("d")).alias("groupby")).select("table", "groupby", F.lit(None).cast("long").alias("at"), F.lit(1).alias("whole"))
    return each.unionByName(whole).join(m, "table").join(first, "table").select("first", "whole", "at", "table", "measures", "groupby")


def pool(shapes: DataFrame) -> DataFrame:
    """Synthesized then observed rollups in the order ties are broken: ``rank, synthetic, table, measures, groupby, filters``."""
    empty = F.array().cast("array<string>")
    c = candidates(shapes).select(F.lit(0).alias("o"), "first", "whole", "at", F.lit(True).alias("synthetic"), "table", "measures", "groupby", empty.alias("filters"))
    s = shapes.select(F.lit(1).alias("o"), F.lit(0).cast("long").alias("first"), F.lit(0).alias("whole"), F.col("shape_id").alias("at"), F.lit(False).alias("synthetic"), "table", "measures", "groupby", "filters")
    return c.unionByName(s).withColumn("rank", F.struct("o", "first", "whole", "at")).drop("o", "first", "whole", "at")


def distinct(shapes: DataFrame) -> DataFrame:
    """Equal shapes as one, with the smallest of their ids and their number ``n``."""
    return shapes.groupBy("table", "measures", "groupby", "filters", "eq_cols").agg(F.min("shape_id").alias("shape_id"), F.count(F.lit(1)).alias("n"))


def _longest(c: Column) -> Column:
    """The longest of some strings, or an empty one: long filters and measures tend to be rare."""
    return F.coalesce(F.array_max(F.transform(c, lambda x: F.struct(F.length(x).alias("l"), x.alias("x"))))["x"], F.lit(""))


def edges(shapes: DataFrame) -> DataFrame:
    """Which rollup of the pool answers which shape: ``rank, shape_id, n, g``; n: statements of the shape (1 if shapes has no such column), g: group of the greedy choice."""
    is_equal = lambda f: F.regexp_extract(f, _EQUAL, 1) != ""
    fixed, equal = F.array_sort(F.array_distinct(F.filter("filters", lambda f: ~is_equal(f)))), F.array_distinct(F.filter("filters", is_equal))
    need = F.transform("measures", lambda m: F.when(m.startswith("avg("), F.concat(F.lit("sum("), F.substring(m, 5, 1 << 20))).otherwise(m))
    none = F.array(F.lit(""))
    a = pool(shapes).select("rank", F.col("table").alias("_t"), fixed.alias("_f"), _longest(equal).alias("_e"), F.struct("table", "measures", "filters", offers_column().alias("have")).alias("a"))
    a = a.withColumn("_m", F.explode(F.array_union("a.measures", none)))
    q = shapes.select("shape_id", F.col("n") if "n" in shapes.columns else F.lit(1).cast("long").alias("n"), F.col("table").alias("_u"), fixed.alias("_v"), _longest(need).alias("_w"), equal.alias("_x"), F.struct("table", "filters", needs_column().alias("need")).alias("q"))
    q = q.withColumn("_x", F.explode(F.array_union("_x", none)))
    same = (F.col("_t") == F.col("_u")) & (F.col("_f") == F.col("_v")) & (F.col("_e") == F.col("_x")) & (F.col("_m") == F.col("_w"))
    return a.join(q, same & subsumes_column()).select("rank", "shape_id", "n", F.xxhash64("_u", "_v").alias("g"))


_RANK = ("o", "first", "whole", "at")
CHOSEN = "o int, first long, whole int, at long, gain long, shape_id long"
#: Edges from which whole groups are handed on.
_EDGES = 200_000


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of CHOSEN from edges sorted by group. Groups share nothing, so several may be chosen from at once."""
    keep: list[pd.DataFrame] = []
    held = 0
    for pdf in batches:
        keep.append(pdf)
        held += len(pdf)
        if held >= _EDGES:
            some = pd.concat(keep, ignore_index=True)
            rest = (some["g"] == some["g"].iloc[-1]).to_numpy()
            if not rest.all():
                yield from _choose(some[~rest])
            keep, held = [some[rest]], 0
    if keep:
        yield from _choose(pd.concat(keep, ignore_index=True))


def _choose(e: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Most statements first, the lowest rank of equal ones; a gain is counted again only when it comes up."""
    if not len(e):
        return
    e = e.sort_values([*_RANK, "shape_id"], ignore_index=True)
    head = (e[[*_RANK]] != e[[*_RANK]].shift()).any(axis=1).to_numpy()
    starts = np.append(np.flatnonzero(head), len(e))
    shape, ids = pd.factorize(e["shape_id"])
    weight = np.zeros(len(ids), np.int64)
    weight[shape] = e["n"].to_numpy()
    left = np.ones(len(ids), bool)
    heap = [(-int(weight[shape[starts[i] : starts[i + 1]]].sum()), i) for i in range(len(starts) - 1)]
    heapq.heapify(heap)
    out = []
    while heap:
        most, i = heapq.heappop(heap)
        mine = shape[starts[i] : starts[i + 1]]
        mine = mine[left[mine]]
        gain = int(weight[mine].sum())
        if gain and gain == -most:
            left[mine] = False
            rank = tuple(e[c].iat[starts[i]] for c in _RANK)
            out += [(*rank, gain, x) for x in ids[mine]]
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=[*_RANK, "gain", "shape_id"])
                out = []
        elif gain:
            heapq.heappush(heap, (-gain, i))
    if out:
        yield pd.DataFrame(out, columns=[*_RANK, "gain", "shape_id"])


def assignment(shapes: DataFrame) -> DataFrame:
    """The covering set, a row a covered shape: ``o, first, whole, at`` (the rollup's rank; at -1: none), ``gain``, the rollup, ``shape_id``.

    Gains are statements newly answered. Rollups in the order chosen are those by falling gain, then rank: gains of a
    group never rise, and the lowest rank of equal gains is chosen first.
    """
    rank = [F.col("rank.o").alias("o"), F.col("rank.first").alias("first"), F.col("rank.whole").alias("whole"), F.coalesce("rank.at", F.lit(-1)).cast("long").alias("at")]
    got = edges(shapes).select(*rank, "shape_id", "n", "g").repartition("g").sortWithinPartitions("g").mapInPandas(_greedy, CHOSEN)
    return got.join(pool(shapes).select(*rank, "synthetic", "table", "measures", "groupby", "filters"), [*_RANK])


def cover(shapes: DataFrame) -> list[tuple[Shape, bool, list[int]]]:
    """Anchors in the order chosen: (rollup, synthetic, shapes it newly answers). The first of equal gains wins. For an experiment's shapes: the set comes to the driver."""
    out: dict[tuple, tuple[Shape, bool, list[int]]] = {}
    for r in sorted(assignment(shapes).collect(), key=lambda r: (-r["gain"], *[r[c] for c in _RANK], r["shape_id"])):
        out.setdefault(tuple(r[c] for c in _RANK), (Shape(r["table"], tuple(r["measures"]), tuple(r["groupby"]), tuple(r["filters"])), r["synthetic"], []))[2].append(r["shape_id"])
    return list(out.values())


def cover_rows(shapes: DataFrame) -> DataFrame:
    """The covering set as rows ``anchor_no, sql, synthetic, shape_id, n``; anchors numbered in the order chosen, without sorting them in one task."""
    spark = shapes.sparkSession
    got = cut(assignment(shapes), name="cover")
    sql = F.concat(F.lit("select "), F.array_join(F.concat("groupby", "measures"), ", "), F.lit(" from "), F.col("table"),
                   F.when(F.size("filters") > 0, F.concat(F.lit(" where "), F.array_join("filters", " and "))).otherwise(""),
                   F.when(F.size("groupby") > 0, F.concat(F.lit(" group by "), F.array_join("groupby", ", "))).otherwise(""))
    anchors = got.groupBy(*_RANK).agg(F.first("gain").alias("gain"), F.first(sql).alias("sql"), F.first("synthetic").alias("synthetic"))
    anchors = cut(anchors.orderBy(F.desc("gain"), *_RANK).withColumn("_at", F.monotonically_increasing_id()), name="anchors")
    first, before = [], 0
    for r in sorted(anchors.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()):  # a row a partition of the sort
        first.append((r["p"], before))
        before += r["count"]
    first_of = F.broadcast(spark.createDataFrame(first, "_p long, _before long"))
    no = (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("anchor_no")
    named = anchors.join(first_of, F.shiftright("_at", 33) == F.col("_p")).select(*_RANK, no, "sql", "synthetic")
    n = shapes.select("shape_id", F.col("n") if "n" in shapes.columns else F.lit(1).cast("long").alias("n"))
    return got.select(*_RANK, "shape_id").join(named, [*_RANK]).join(n, "shape_id").select("anchor_no", "sql", "synthetic", "shape_id", "n")


# --- sub-expressions ------------------------------------------------------------------------------------------------

def subexpressions(shapes: DataFrame) -> DataFrame:
    """One row a sub-expression: ``shape_id, size, kind, key``."""
    scan = F.concat(F.lit("scan("), "table", F.lit(")"))
    by = F.array_join("groupby", ",")
    where = F.array_join("filters", "&")

    def part(size: int, kind: str, k: Column) -> Column:
        return F.struct(F.lit(size).alias("size"), F.lit(kind).alias("kind"), k.alias("key"))

    some = F.concat(
        F.array(part(1, "scan", scan), part(2, "filtered_scan", F.concat(scan, F.lit("|"), where)), part(4, "full_agg", F.concat(scan, F.lit("|"), where, F.lit("|by:"), by, F.lit("|"), F.array_join("measures", ",")))),
        F.transform("filters", lambda f: part(1, "filter", F.concat(scan, F.lit("|"), f))), F.transform("measures", lambda m: part(2, "measure", F.concat(scan, F.lit("|"), m))),
        F.when(F.size("groupby") > 0, F.array(part(3, "grouping", F.concat(scan, F.lit("|by:"), by)))).otherwise(F.array().cast("array<struct<size:int,kind:string,key:string>>")))
    return shapes.select("shape_id", F.explode(some).alias("x")).select("shape_id", "x.*")


def subexpression_ratios(parts: DataFrame) -> DataFrame:
    """Total and distinct by size and kind, and overall (kind ``all``, by key alone)."""
    g = parts.groupBy("size", "kind").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("key").alias("distinct"))
    whole = parts.agg(F.lit(0).alias("size"), F.lit("all").alias("kind"), F.count(F.lit(1)).alias("total"), F.count_distinct("key").alias("distinct"))
    return g.unionByName(whole).withColumn("ratio", F.when(F.col("total") > 0, F.col("distinct") / F.col("total")).otherwise(1.0))


# --- answering from a rollup ----------------------------------------------------------------------------------------

def build(table: DataFrame, anchor: Shape) -> DataFrame:
    """The rollup's rows; a column is named by its key. For each sum(x) the count of x is kept, too, so averages are right."""
    t = table.where(" and ".join(f"({f})" for f in anchor.filters)) if anchor.filters else table
    hidden = [f"count({m[4:-1]})" for m in anchor.measures if m.startswith("sum(")]
    measures = list(dict.fromkeys([*anchor.measures, *hidden]))
    dims = [F.expr(g).alias(g) for g in anchor.groupby]
    aggs = [F.expr(m).alias(m) for m in measures]
    return t.groupBy(*dims).agg(*aggs) if dims else t.agg(*aggs)


def answer(rollup: DataFrame, anchor: Shape, query: Shape) -> DataFrame:
    """The query's result from the rollup's rows: filter, regroup, re-aggregate; columns named by key."""
    if not subsumes(anchor, query):
        raise ValueError("the rollup does not answer this query")
    for f in query.filters:
        if f not in anchor.filters:
            rollup = rollup.where(f)
    dims = [(F.col(f"`{g}`") if g in anchor.groupby else F.expr(g)).alias(g) for g in query.groupby]
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    aggs = []
    for m in query.measures:
        name, inner = m.split("(", 1)[0], m.split("(", 1)[1][:-1]
        if m.startswith("count(distinct "):
            aggs.append(F.first(F.col(f"`{m}`")).alias(m))
        elif name == "avg":
            aggs.append((F.sum(F.col(f"`sum({inner})`")) / F.sum(F.col(f"`count({inner})`"))).alias(m))
        elif name == "count":
            aggs.append(F.coalesce(F.sum(F.col(f"`{m}`")), F.lit(0)).alias(m))
        else:
            aggs.append(again[name](F.col(f"`{m}`")).alias(m))
    return rollup.groupBy(*dims).agg(*aggs) if dims else rollup.agg(*aggs)
