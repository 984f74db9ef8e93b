"""Parent-child links to full hierarchies, by bottom-up leaf peeling.

A node names at most one parent within its group (trace), so the links of a group form trees and, where they run
in a circle, rings with trees hanging off them. Leaves are peeled round by round; each sends its subtree size and, where
descendants are asked for, its list of descendants to its parent. What cannot be peeled is exactly the set of nodes on a
ring. In reverse peel order every node then gets its depth, root, depth-first position and path from its parent.

Groups up to ``max_task_nodes`` are peeled inside one task over integer arrays (many groups a task, one shuffle for all
of them). Peeling takes as many rounds as the deepest chain is long, too many for rounds that are joins; larger groups are
therefore contracted by doubling: in round j every node hands sizes, lists and paths over to, or takes them from, its
2**j-th ancestor, so a chain of n nodes takes log2(n) joins. A node still under way after n steps leads into a ring, and
where those nodes have arrived is the ring. No group has to fit a task, and both ways give the same rows.

Defined results
---------------
* ids are compared trimmed and in lower case; the form of the row with the smallest order value is returned;
* a parent that is null, blank or ``-``, or that is not in the group, makes the node a root;
* a node delivered more than once is one node; its parent is that of the latest delivery;
* rows whose group or node id is null or blank are no nodes and give no row;
* ``status`` is ``tree``, ``cycle`` (on a ring, a node naming itself included) or ``leads_to_cycle``; outside ``tree``
  root, depth and path are null; ``subtree_size`` counts the node and its descendants, null on a ring;
* descendants are those of every node: below one that leads into a ring as in a tree; those of a node on a ring are all
  other nodes of the ring and all that leads into it;
* an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import cut, release

RESULT = (
    "trace_id string, span_id string, parent_id string, status string, root_id string, depth int, "
    "path array<string>, subtree_size long"
)
PAIRS = "trace_id string, ancestor_id string, descendant_id string, distance int"
ORDER = "trace_id string, span_id string, parent_id string, depth int, position long"
#: Path elements or pairs an output batch holds about, so deep groups stream out in pieces.
BATCH_ELEMENTS = 200_000
#: Nodes from which buffered whole groups are worked on.
_NODES = 4096


def clean_id(c: Column) -> Column:
    """An id as it is compared: trimmed, lower case; null where it stands for nothing."""
    t = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when((t != "") & (t != "-"), t)


def nodes(
    df: DataFrame, group: str = "trace_id", node: str = "span_id", parent: str = "parent_span_id",
    order: str = "row_id", delivered: str = "ingested_at", at: str | None = None,
) -> DataFrame:
    """One row a node: ``g, k, p, shown, at`` (group, key, parent key or null, node id as written, sort value of siblings)."""
    rows = df.select(
        clean_id(F.col(group)).alias("g"), clean_id(F.col(node)).alias("k"), clean_id(F.col(parent)).alias("p"),
        F.col(node).alias("_shown"), F.struct(F.col(delivered), F.col(order)).alias("_late"), F.col(order).alias("_o"),
        (F.coalesce(F.col(at).cast("long"), F.lit(0)) if at else F.lit(0)).cast("long").alias("_at"),
    ).where("g is not null and k is not null")
    return rows.groupBy("g", "k").agg(F.max_by("p", "_late").alias("p"), F.min_by("_shown", "_o").alias("shown"), F.max_by("_at", "_late").alias("at"))


# --- groups that fit a task -----------------------------------------------------------------------------------------

def peel(parent: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Peel one forest given as parent positions (-1: root).

    Returns the rounds (positions peeled together, leaves first), the subtree sizes, and a mask of what could not be peeled.
    """
    n = len(parent)
    waiting = np.bincount(parent[parent >= 0], minlength=n)
    size = np.ones(n, np.int64)
    rounds, leaves = [], np.flatnonzero(waiting == 0)
    left = np.ones(n, bool)
    while len(leaves):
        rounds.append(leaves)
        left[leaves] = False
        up = leaves[parent[leaves] >= 0]
        if not len(up):
            break
        to = parent[up]
        np.add.at(size, to, size[up])
        np.subtract.at(waiting, to, 1)
        to = np.unique(to)
        leaves = to[(waiting[to] == 0) & left[to]]
    return rounds, size, left


@dataclass
class Forest:
    """The nodes of some whole groups: names as Arrow columns, links as positions (-1: none)."""
    g: pa.Array
    shown: pa.Array
    at: np.ndarray
    group: np.ndarray
    parent: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Forest:
        t = t.combine_chunks()
        g, k, p, shown, at = (t[c].chunk(0) if t[c].num_chunks else t[c].combine_chunks() for c in ("g", "k", "p", "shown", "at"))
        code = g.dictionary_encode().indices
        number = code.cast(pa.string())
        keys, wanted = (pc.binary_join_element_wise(number, x, "\0") for x in (k, p))
        parent = pc.fill_null(pc.index_in(wanted, value_set=keys), -1).to_numpy().astype(np.int64)
        rank = np.empty(len(g), np.int64)
        rank[pc.sort_indices(pa.table({"at": at, "k": k}), sort_keys=[("at", "ascending"), ("k", "ascending")]).to_numpy()] = np.arange(len(g))
        return cls(g, shown, at.to_numpy(), code.to_numpy().astype(np.int64), parent, rank)

    def down(self, rounds: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Root, depth and depth-first position (from 0 within the group) of every node of a tree, in reverse peel order; -1 elsewhere."""
        n = len(self.parent)
        family = np.where(self.parent >= 0, self.parent, -1 - self.group)
        by = np.lexsort((self.rank, family))
        before = np.cumsum(size[by]) - size[by]
        head = np.ones(n, bool)
        head[1:] = family[by][1:] != family[by][:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        ahead = np.empty(n, np.int64)  # sizes of the siblings that come before
        # roots of trees only are counted among themselves: a ring has none
        ahead[by] = before - before[first]
        root, depth, place = (np.full(n, -1, np.int64) for _ in range(3))
        for r in reversed(rounds):
            q = self.parent[r]
            top = q < 0
            known = top | (root[q] >= 0)
            r, q, top = r[known], q[known], top[known]
            root[r] = np.where(top, r, root[q])
            depth[r] = np.where(top, 0, depth[q] + 1)
            place[r] = np.where(top, 0, place[q] + 1) + ahead[r]
        return root, depth, place

    def take(self, names: pa.Array, at: np.ndarray) -> pa.Array:
        return names.take(pa.array(at, mask=at < 0))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Forest]:
    """Partitions sorted by group: whole groups, buffered to some thousand nodes."""
    keep: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        keep.append(b)
        held += b.num_rows
        last = b.column("g")[b.num_rows - 1]
        if held < _NODES or keep[0].column("g")[0].as_py() == last.as_py():
            continue
        t = pa.Table.from_batches(keep)
        end = pc.index(t["g"], last).as_py()
        yield Forest.of(t.slice(0, end))
        keep, held = t.slice(end).to_batches(), t.num_rows - end
    if keep:
        yield Forest.of(pa.Table.from_batches(keep))


def _rows(paths: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RESULT."""
    for f in _whole_groups(batches):
        rounds, size, ring = peel(f.parent)
        root, depth, place = f.down(rounds, size)
        in_tree = np.flatnonzero(root >= 0)
        in_tree = in_tree[np.lexsort((place[in_tree], f.group[in_tree]))]
        length = depth[in_tree] + 1 if paths else np.ones(len(in_tree), np.int64)
        ends = np.cumsum(length)
        stack = np.empty(int(depth.max(initial=0)) + 1, np.int64)
        lo = 0
        while lo < len(in_tree):
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + BATCH_ELEMENTS, "right")))
            some = in_tree[lo:hi]
            path: pa.Array = pa.nulls(len(some), pa.list_(pa.string()))
            if paths:
                offsets = np.concatenate([[0], ends[lo:hi] - base])
                flat = np.empty(offsets[-1], np.int64)
                # depth-first order: the stack up to a node's depth is its path
                for i, d, a in zip(some.tolist(), depth[some].tolist(), offsets.tolist()):
                    stack[d] = i
                    flat[a : a + d + 1] = stack[: d + 1]
                path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), f.shown.take(pa.array(flat)))
            yield _result(f, some, pa.array(["tree"] * len(some)), root, depth, path, size)
            lo = hi
        rest = np.flatnonzero(root < 0)
        if len(rest):
            status = pa.array(np.where(ring[rest], "cycle", "leads_to_cycle").tolist())
            yield _result(f, rest, status, root, depth, pa.nulls(len(rest), pa.list_(pa.string())), np.where(ring, -1, size))


def _result(f: Forest, some: np.ndarray, status: pa.Array, root: np.ndarray, depth: np.ndarray, path: pa.Array, size: np.ndarray) -> pa.RecordBatch:
    at = pa.array(some)
    number = lambda x, kind: pa.array(x[some], kind, mask=x[some] < 0)
    return pa.RecordBatch.from_arrays(
        [f.g.take(at), f.shown.take(at), f.take(f.shown, f.parent[some]), status, f.take(f.shown, root[some]), number(depth, pa.int32()), path, number(size, pa.int64())],
        ["trace_id", "span_id", "parent_id", "status", "root_id", "depth", "path", "subtree_size"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ORDER."""
    for f in _whole_groups(batches):
        rounds, size, _ = peel(f.parent)
        root, depth, place = f.down(rounds, size)
        some = np.flatnonzero(root >= 0)
        at = pa.array(some)
        yield pa.RecordBatch.from_arrays(
            [f.g.take(at), f.shown.take(at), f.take(f.shown, f.parent[some]), pa.array(depth[some], pa.int32()), pa.array(place[some] + 1, pa.int64())],
            ["trace_id", "span_id", "parent_id", "depth", "position"])


def lists(parent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Descendants of every node of a forest: arrays of (ancestor, descendant, distance), in pieces.

    A peeled node gives out its list, complete by then, and sends it, itself added, to its parent. Lists not yet sent are
    disjoint, so what is held never exceeds the nodes. Nodes of a ring keep what hangs below them and take over the others'.
    """
    rounds, _, ring = peel(parent)
    when = np.full(len(parent), len(rounds))
    for r, x in enumerate(rounds):
        when[x] = r
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for r, leaves in enumerate(rounds):
        got = held.pop(r, [])
        above, below, distance = (np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
        if len(above):
            yield above, below, distance
        above, below, distance = np.concatenate([above, leaves]), np.concatenate([below, leaves]), np.concatenate([distance, np.zeros(len(leaves), np.int64)])
        up = parent[above]
        sent = up >= 0
        up, below, distance = up[sent], below[sent], distance[sent] + 1
        due = when[up]
        for x in np.unique(due):
            mine = due == x
            held.setdefault(int(x), []).append((up[mine], below[mine], distance[mine]))
    if not ring.any():
        return
    hung = held.pop(len(rounds), [])
    on = np.flatnonzero(ring)
    above, below, distance = (np.concatenate(c) for c in zip(*hung, (on, on, np.zeros(len(on), np.int64))))
    number, step, around = np.full(len(parent), -1), np.zeros(len(parent), np.int64), []
    for i in on.tolist():  # rings, in the order of their links
        if number[i] < 0:
            circle, j = [], i
            while number[j] < 0:
                number[j], step[j] = len(around), len(circle)
                circle.append(j)
                j = int(parent[j])
            around.append(circle)
    by = np.argsort(number[above], kind="stable")
    edges = np.searchsorted(number[above][by], np.arange(len(around) + 1))
    for c, circle in enumerate(around):
        mine = by[edges[c] : edges[c + 1]]
        at, x, d = step[above[mine]], below[mine], distance[mine]
        for t, i in enumerate(circle):
            other = x != i
            yield np.full(int(other.sum()), i), x[other], (d + (t - at) % len(circle))[other]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PAIRS."""
    def out(f: Forest, some: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        above, below, distance = (np.concatenate(c) for c in zip(*some))
        for a in range(0, len(above), BATCH_ELEMENTS):
            u, v = pa.array(above[a : a + BATCH_ELEMENTS]), pa.array(below[a : a + BATCH_ELEMENTS])
            yield pa.RecordBatch.from_arrays([f.g.take(u), f.shown.take(u), f.shown.take(v), pa.array(distance[a : a + BATCH_ELEMENTS], pa.int32())], ["trace_id", "ancestor_id", "descendant_id", "distance"])

    for f in _whole_groups(batches):
        some: list = []
        held = 0
        for piece in lists(f.parent):
            some.append(piece)
            held += len(piece[0])
            if held >= BATCH_ELEMENTS:
                yield from out(f, some)
                some, held = [], 0
        if some:
            yield from out(f, some)


def _in_tasks(one: DataFrame, work: Callable, schema: str) -> DataFrame:
    return one.select("g", "k", "p", "shown", "at").repartition("g").sortWithinPartitions("g").mapInArrow(work, schema)


def _parts(one: DataFrame, counts: DataFrame, max_task_nodes: int) -> tuple[DataFrame, DataFrame | None]:
    """Nodes of groups that fit a task, and those of larger ones (None if there are none). counts: ``g, count``."""
    large = counts.where(F.col("count") > max_task_nodes).select("g")
    if large.limit(1).count() == 0:
        return one, None
    large = cut(large, name="large")  # at most a row for max_task_nodes rows of the table
    return one.join(large, "g", "left_anti"), cut(one.join(large, "g", "left_semi"), name="nodes")


# --- larger groups --------------------------------------------------------------------------------------------------

def _linked(one: DataFrame) -> DataFrame:
    """Nodes with ``up``, the shown form of their parent; a parent that is not there is none."""
    known = one.select("g", F.col("k").alias("p"), F.col("shown").alias("up"))
    return one.join(known, ["g", "p"], "left").withColumn("p", F.when(F.col("up").isNotNull(), F.col("p"))).select("g", "k", "p", "shown", "at", "up")


def _under_way(state: DataFrame) -> bool:
    return state.where("up is not null").limit(1).count() > 0


def _along(linked: DataFrame, start: Column, add: Callable[[Column, Column], Column]) -> DataFrame:
    """``g, k, x``: the start values of a node and all above it put together, ``add(above, own)``; trees only."""
    state = cut(linked.select("g", "k", F.col("p").alias("up"), start.alias("x")), name="along")
    while _under_way(state):
        above = state.select("g", F.col("k").alias("up"), F.col("up").alias("_next"), F.col("x").alias("_x"))
        moved = state.where("up is not null").join(above, ["g", "up"]).select("g", "k", F.col("_next").alias("up"), add(F.col("_x"), F.col("x")).alias("x"))
        after = cut(state.where("up is null").unionByName(moved), name="along")
        release(state)
        state = after
    return state.select("g", "k", "x")


def _contracted(linked: DataFrame) -> DataFrame:
    """``g, k, status, root, depth, size`` by doubling; root as key."""
    most = linked.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    none = F.lit(None)
    state = cut(linked.select("g", "k", F.col("p").alias("up"), F.when(F.col("p").isNull(), F.col("k")).alias("root"), F.when(F.col("p").isNull(), 0).cast("long").alias("depth"), F.lit(1).cast("long").alias("size")), name="double")
    span = 1
    while span < most and _under_way(state):
        sent = state.where("up is not null").groupBy("g", F.col("up").alias("k")).agg(F.sum("size").alias("got"))
        above = state.select("g", F.col("k").alias("up"), F.col("up").alias("_next"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        moved = state.where("up is not null").join(above, ["g", "up"]).select("g", "k", F.col("_next").alias("up"), F.col("_root").alias("root"), (F.col("_depth") + span).alias("depth"), "size")
        both = state.where("up is null").unionByName(moved)
        after = cut(both.join(sent, ["g", "k"], "left").select("g", "k", "up", "root", "depth", (F.col("size") + F.coalesce("got", F.lit(0))).alias("size")), name="double")
        release(state)
        state, span = after, 2 * span
    ring = state.where("up is not null").select("g", F.col("up").alias("k"), F.lit(True).alias("_ring")).distinct()  # where all have arrived
    status = F.when(F.col("up").isNull(), "tree").when(F.col("_ring"), "cycle").otherwise("leads_to_cycle")
    return state.join(ring, ["g", "k"], "left").select("g", "k", status.alias("status"), F.when(F.col("up").isNull(), F.col("root")).alias("root"),
                                                       F.when(F.col("up").isNull(), F.col("depth")).cast("int").alias("depth"), F.when(F.col("_ring"), none).otherwise(F.col("size")).cast("long").alias("size"))


def _large(one: DataFrame, paths: bool) -> DataFrame:
    """Rows of RESULT for large groups."""
    linked = cut(_linked(one), name="linked")
    found = cut(_contracted(linked), name="found")
    names = one.select("g", F.col("k").alias("root"), F.col("shown").alias("root_id"))
    x = linked.join(found, ["g", "k"]).join(names, ["g", "root"], "left")
    if paths:
        in_tree = linked.join(found.where("status = 'tree'").select("g", "k"), ["g", "k"], "left_semi")
        x = x.join(_along(in_tree, F.array("shown"), F.concat).withColumnRenamed("x", "path"), ["g", "k"], "left")
    else:
        x = x.withColumn("path", F.lit(None).cast("array<string>"))
    return x.select(F.col("g").alias("trace_id"), F.col("shown").alias("span_id"), F.col("up").alias("parent_id"), "status", "root_id", "depth", "path", F.col("size").alias("subtree_size"))


def _large_order(one: DataFrame) -> DataFrame:
    """Rows of ORDER for large groups: a node comes after its parent and all that hangs below earlier siblings."""
    linked = cut(_linked(one), name="linked")
    found = cut(_contracted(linked).where("status = 'tree'"), name="found")
    tree = linked.join(found.select("g", "k", "depth", "size"), ["g", "k"])
    earlier = Window.partitionBy("g", "p").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, -1)
    ahead = tree.withColumn("_ahead", F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.when(F.col("p").isNull(), 0).otherwise(1))
    place = _along(ahead, F.col("_ahead"), lambda a, b: a + b)
    return tree.join(place, ["g", "k"]).select(F.col("g").alias("trace_id"), F.col("shown").alias("span_id"), F.col("up").alias("parent_id"), "depth", (F.col("x") + 1).alias("position"))


def _large_pairs(one: DataFrame) -> DataFrame:
    """Rows of PAIRS for large groups: in round j lists of descendants go to the 2**j-th ancestor; round a ring the shortest way counts."""
    linked = cut(_linked(one), name="linked")
    status = _contracted(linked).select("g", F.col("k").alias("below"), (F.col("status") == "tree").alias("tree"))
    most = linked.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    state = cut(linked.select("g", "k", F.col("p").alias("up")), name="up")
    held = cut(linked.select("g", F.col("k").alias("above"), F.col("k").alias("below"), F.lit(0).alias("distance")).join(status, ["g", "below"]), name="lists")
    span = 1
    while span <= most and _under_way(state):
        to = state.where("up is not null").select("g", F.col("k").alias("above"), "up")
        sent = held.join(to, ["g", "above"]).select("g", F.col("up").alias("above"), "below", (F.col("distance") + span).alias("distance"), "tree")
        all_ = held.select("g", "above", "below", "distance", "tree").unionByName(sent)
        off = all_.where("not tree").groupBy("g", "above", "below").agg(F.min("distance").alias("distance")).withColumn("tree", F.lit(False))
        after = cut(all_.where("tree").unionByName(off), name="lists")
        higher = cut(state.join(state.select("g", F.col("k").alias("up"), F.col("up").alias("_next")), ["g", "up"], "left").select("g", "k", F.col("_next").alias("up")), name="up")
        release(held, state)
        held, state, span = after, higher, 2 * span
    name = lambda c, shown: one.select("g", F.col("k").alias(c), F.col("shown").alias(shown))
    return held.where("above <> below").join(name("above", "ancestor_id"), ["g", "above"]).join(name("below", "descendant_id"), ["g", "below"]).select(
        F.col("g").alias("trace_id"), "ancestor_id", "descendant_id", F.col("distance").cast("int").alias("distance"))


# --- operators ------------------------------------------------------------------------------------------------------

def _counts(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(clean_id(F.col(group)).alias("g")).count().where("g is not null")


def hierarchy(
    df: DataFrame, group: str = "trace_id", node: str = "span_id", parent: str = "parent_span_id",
    order: str = "row_id", delivered: str = "ingested_at", max_task_nodes: int = 500_000, paths: bool = True,
) -> DataFrame:
    """Path, depth, root and subtree size of every node; see the module's docstring for the defined results.

    paths: without it the path column stays null. The paths of a chain of n nodes have n * n / 2 elements, so callers that do
    not read them may leave them out.
    """
    few, many = _parts(nodes(df, group, node, parent, order, delivered), _counts(df, group), max_task_nodes)
    out = _in_tasks(few, partial(_rows, paths), RESULT)
    return out.unionByName(_large(many, paths)) if many is not None else out


def depth_first(
    df: DataFrame, at: str, group: str = "trace_id", node: str = "span_id", parent: str = "parent_span_id",
    order: str = "row_id", delivered: str = "ingested_at", max_task_nodes: int = 500_000,
) -> DataFrame:
    """The nodes of trees in depth-first order: rows of ORDER, position from 1 within the group; siblings by ``at``, ties by id."""
    few, many = _parts(nodes(df, group, node, parent, order, delivered, at), _counts(df, group), max_task_nodes)
    out = _in_tasks(few, _in_order, ORDER)
    return out.unionByName(_large_order(many)) if many is not None else out


def descendants_of(
    df: DataFrame, group: str = "trace_id", node: str = "span_id", parent: str = "parent_span_id",
    order: str = "row_id", delivered: str = "ingested_at", max_task_nodes: int = 500_000,
) -> DataFrame:
    """All (ancestor, descendant, distance) pairs, a node with itself not included.

    Outside trees, too: an ancestor is every other node met when the links are followed up, distance the links to it. So a
    node on a ring has as descendants all other nodes of its ring and all that leads into it.
    """
    few, many = _parts(nodes(df, group, node, parent, order, delivered), _counts(df, group), max_task_nodes)
    out = _in_tasks(few, _pairs, PAIRS)
    return out.unionByName(_large_pairs(many)) if many is not None else out


def descendants(tree: DataFrame, max_task_nodes: int = 500_000) -> DataFrame:
    """The pairs of :func:`descendants_of` from a :func:`hierarchy` result."""
    tree = cut(tree.select(F.col("trace_id").alias("g"), F.col("span_id").alias("k"), F.col("parent_id").alias("p"), F.col("span_id").alias("shown"), F.lit(0).cast("long").alias("at")), name="tree")  # read twice
    few, many = _parts(tree, tree.groupBy("g").count(), max_task_nodes)
    out = _in_tasks(few, _pairs, PAIRS)
    return out.unionByName(_large_pairs(many)) if many is not None else out
