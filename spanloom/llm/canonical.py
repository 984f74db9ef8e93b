"""Duplicates hidden by formatting differences: one record per statement and its exact number of copies.

Every statement is brought to one canonical form (:func:`canonical`). Canonical records are then range-partitioned by
(form, row id), sorted within the partition (Spark's external sort spills, so no partition must fit memory) and scanned
once: adjacent records with the same full form are one run, and the scan counts it. The range includes the row id, so a form
that holds a third of all rows is spread over as many partitions as its size asks for; a run that crosses partition edges
is joined up from two rows a partition, in a task, so no statement goes to the driver.

What the canonical form ignores: white space of any kind, letter case (of literals, too), a closing semicolon, quotes
around identifiers, the shape of quotation marks and other punctuation, brackets around a whole conjunct or item, and
the order of select items, of WHERE conjuncts and of group keys. Operators, digits, aliases, the order of ORDER BY and
LIMIT are kept.

Defined results: null statements are no records; an empty or blank statement is a record of the empty form; repeated
rows count as they stand; ties are impossible (row ids are unique); an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import cut

#: Punctuation written in other shapes, and the plain shape.
PLAIN = str.maketrans({
    "‘": "'", "’": "'", "‚": "'", "′": "'", "＇": "'", "“": '"', "”": '"', "„": '"', "＂": '"',
    "；": ";", "，": ",", "（": "(", "）": ")", "＝": "=", "＜": "<", "＞": ">", "＊": "*", "。": ".",
    "​": " ", "⁠": " ", "﻿": " ", "­": "",
})
TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^']|'')*')|(?P<name>"[^"]*"|`[^`]*`|\[[A-Za-z_][^\]]*\])"""
    r"""|(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<word>[^\W\d]\w*)|(?P<op><>|!=|<=|>=|\|\||::|=>|->|.)""", re.S)
#: Words that begin a clause at the outermost level; "group" and "order" take the "by" after them along.
CLAUSES = ("select", "from", "where", "group", "having", "window", "order", "limit", "offset", "fetch", "union", "intersect", "except")


def tokens(sql: str) -> list[str]:
    """Lower-case tokens without white space, comments and identifier quotes; literals keep their quotes."""
    out = []
    sql = sql.translate(PLAIN)
    closed = sql.rfind("*/") + 2
    if sql.find("/*", closed if closed > 1 else 0) >= 0:  # an opened comment that never ends is no comment
        at = closed if closed > 1 else 0
        sql = sql[:at] + sql[at:].replace("/*", "/ *")
    for m in TOKEN.finditer(sql):
        kind, t = m.lastgroup, m.group()
        if kind == "space":
            continue
        if kind == "text":
            t = "'" + " ".join(t[1:-1].split()) + "'"
        elif kind == "name":
            t = " ".join(t[1:-1].split())
        out.append(t.lower())
    while out and out[-1] == ";":
        out.pop()
    return out


def _split(toks: list[str], at: str) -> list[list[str]]:
    """Split at a token outside brackets and CASE; an AND that belongs to a BETWEEN does not split."""
    parts: list[list[str]] = [[]]
    depth, between = 0, 0
    for t in toks:
        if t in ("(", "case"):
            depth += 1
        elif t in (")", "end"):
            depth -= 1
        elif depth == 0 and t == "between":
            between += 1
        if t == at and depth == 0:
            if at == "and" and between:
                between -= 1
            else:
                parts.append([])
                continue
        parts[-1].append(t)
    return parts


def _bare(toks: list[str]) -> list[str]:
    """Without brackets around the whole."""
    while len(toks) > 2 and toks[0] == "(" and toks[-1] == ")":
        depth = 0
        for i, t in enumerate(toks):
            depth += (t == "(") - (t == ")")
            if depth == 0 and i < len(toks) - 1:
                return toks
        toks = toks[1:-1]
    return toks


def _conjuncts(toks: list[str]) -> list[str]:
    out = []
    for part in _split(_bare(toks), "and"):
        inner = _bare(part)
        if inner is not part and len(_split(inner, "and")) > 1:
            out += _conjuncts(inner)
        else:
            out.append(" ".join(inner))
    return out


def _has(toks: list[str], word: str) -> bool:
    depth = 0
    for t in toks:
        depth += (t in ("(", "case")) - (t in (")", "end"))
        if depth == 0 and t == word:
            return True
    return False


def canonical(sql: str) -> str:
    """The canonical form of a statement."""
    toks = tokens(sql)
    clauses: list[tuple[str, list[str]]] = [("", [])]
    depth = 0
    for i, t in enumerate(toks):
        depth += (t == "(") - (t == ")")
        if depth == 0 and t in CLAUSES:
            clauses.append((t, []))
        elif t == "by" and clauses[-1][0] in ("group", "order") and not clauses[-1][1] and toks[i - 1] in ("group", "order"):
            continue
        else:
            clauses[-1][1].append(t)
    out, items = [], []
    for word, body in clauses:
        if word == "select":
            lead = []
            while body and body[0] in ("distinct", "all"):
                lead.append(body[0])
                body = body[1:]
            items = [" ".join(_bare(p)) for p in _split(body, ",")]
            text = " ".join([*lead, " , ".join(sorted(items))])
        elif word == "where" and not _has(_bare(body), "or"):
            text = " and ".join(sorted(_conjuncts(body)))
        elif word == "where":
            text = " ".join(_bare(body))
        elif word in ("group", "order"):
            keys = []
            for p in _split(body, ","):
                k = _bare(p)
                if k and k[0].isdigit() and 0 < int(k[0]) <= len(items):
                    k = ["#", items[int(k[0]) - 1], *k[1:]]  # a position names an item, wherever the item stands
                keys.append(" ".join(k))
            text = " , ".join(sorted(keys) if word == "group" else keys)
        else:
            text = " ".join(body)
        if word or text:
            out.append(f"{word} {text}".strip())
    return " ; ".join(out) if len(out) > 1 else (out[0] if out else "")


def _canonical_series(s: pd.Series) -> pd.Series:
    code, texts = pd.factorize(s)  # a statement that comes again in a batch is read once
    forms = np.array([canonical(t) for t in texts] + [None], dtype=object)
    return pd.Series(forms[code], index=s.index)


def canonical_of(c: Column) -> Column:
    """The canonical form of a column of statements."""
    return F.pandas_udf(_canonical_series, "string")(c)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: each record with the number of its run and the first row id of the run here; last: the run's last record here, with ``upto`` records of it.

    Full keys are compared, neighbour with neighbour; run 0 and the last run may go on in the neighbouring partitions.
    """
    held: pa.RecordBatch | None = None  # the last record, until it is known whether its run goes on
    first, run, length = 0, -1, 0
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        form, rid = b.column("form"), b.column("rid").to_numpy()
        n = b.num_rows
        new = np.ones(n, bool)
        new[1:] = ~pc.equal(form.slice(1), form.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if held is None:
            run, length = run + 1, 0
        new[0] = False
        number = run + np.cumsum(new)
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        firsts = np.where(number == run, first if held is not None else rid[0], rid[start])
        upto = np.arange(n) - start + 1 + np.where(number == run, max(length - 1, 0), 0)
        yield _run_rows(b, n - 1, number, firsts, upto, np.append(new[1:], False))
        first, run, length = int(firsts[-1]), int(number[-1]), int(upto[-1])
        held = b.slice(n - 1)
    if held is not None:
        yield _run_rows(held, 1, np.array([run]), np.array([first]), np.array([length]), np.array([True]))


def _run_rows(b: pa.RecordBatch, n: int, number: np.ndarray, firsts: np.ndarray, upto: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [b.column("part").slice(0, n), pa.array(number[:n], pa.int64()), pa.array(firsts[:n], pa.int64()), b.column("rid").slice(0, n), b.column("form").slice(0, n), pa.array(upto[:n], pa.int64()), pa.array(last[:n])],
        ["part", "run", "first_here", "rid", "form", "upto", "last"])


RUNS = "part int, run long, first_here long, rid long, form string, upto long, last boolean"


def _scanned(df: DataFrame, text: str, row_id: str) -> DataFrame:
    """The records in order of their forms, scanned (RUNS)."""
    rows = df.where(F.col(text).isNotNull()).select(canonical_of(F.col(text)).alias("form"), F.col(row_id).cast("long").alias("rid"))
    rows = cut(rows, name="canonical")  # forms are made once: sampling for the ranges reads them a second time
    ordered = rows.repartitionByRange("form", "rid").sortWithinPartitions("form", "rid").withColumn("part", F.spark_partition_id())
    return cut(ordered.mapInArrow(_runs, RUNS), name="runs")


def _carried(scanned: DataFrame) -> DataFrame:
    """Runs that touch a partition's edge and go on from one of an earlier partition: ``part, run, begun`` (row id the run began with)."""
    ends = scanned.where("last").groupBy("part").agg(F.max("run").alias("_most"))
    edge = scanned.where("last").join(ends, "part").where("run = 0 or run = _most").select("part", "run", "_most", "form", "first_here")
    order = Window.orderBy("part", "run")  # two rows a partition
    before = edge.withColumns({"_form": F.lag("form").over(order), "_part": F.lag("part").over(order)})
    joins = (F.col("run") == 0) & (F.col("_part") < F.col("part")) & (F.col("_form") == F.col("form"))
    chain = before.select("part", "run", "first_here", F.coalesce(joins, F.lit(False)).alias("goes_on"))
    begun = F.last(F.when(~F.col("goes_on"), F.col("first_here")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return chain.withColumn("begun", begun).where("goes_on").select("part", "run", "begun")


def runs(df: DataFrame, text: str = "sql_text", row_id: str = "row_id") -> DataFrame:
    """Every record with its group: ``form, first_row_id, row_id``. first_row_id is the smallest of the group."""
    scanned = _scanned(df, text, row_id)
    at = cut(_carried(scanned), name="carried")  # at most a row a partition
    whole = scanned.join(at, ["part", "run"], "left")
    return whole.select("form", F.coalesce("begun", "first_here").alias("first_row_id"), F.col("rid").alias("row_id"))


def representatives(df: DataFrame, text: str = "sql_text", row_id: str = "row_id") -> DataFrame:
    """One record a group: ``first_row_id, form, copies`` (rows of the group, the first included).

    The scan has counted its runs; only runs that cross a partition's edge are added up, so rows are not shuffled again.
    """
    scanned = _scanned(df, text, row_id).where("last")  # a row a run and partition
    at = cut(_carried(scanned), name="carried")
    whole = scanned.join(at, ["part", "run"], "left").select("form", F.coalesce("begun", "first_here").alias("first_row_id"), "upto", F.col("begun").isNotNull().alias("_on"))
    crossing = whole.where("_on").groupBy("first_row_id").agg(F.sum("upto").alias("_more"))  # at most a row a partition
    return whole.where("not _on").join(crossing, "first_row_id", "left").select("first_row_id", "form", (F.col("upto") + F.coalesce("_more", F.lit(0))).alias("copies"))
