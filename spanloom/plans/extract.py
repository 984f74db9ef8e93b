"""Shapes of whole tables of statements, on the executors.

A small recursive-descent reader for what a shape can be: one SELECT over one table with bare aggregates, plain columns
and functions as keys, and a conjunction as condition. Keys are written as :mod:`spanloom.plans.sqlplan` writes them (strict mode);
everything else is declined with a reason. Identifiers may be quoted with double quotes, as warehouses do.

Defined results: null or empty statements are declined as such; nothing is guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.sqlplan import MEASURES, Declined, Shape

_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|(?P<text>'(?:[^']|'')*')|(?P<quoted>\"[^\"]+\"|`[^`]+`)|(?P<number>\d+(?:\.\d+)?)|(?P<word>[^\W\d]\w*)|(?P<op><=>|<>|!=|<=|>=|::|[-+*/%=<>(),.;])|(?P<other>.)", re.S)
#: Words that end an expression or are no plain column.
_STOP = frozenset("select from where group order by having limit offset union intersect except join on left right inner full cross window qualify as and or not between in is like ilike rlike case when then else end over filter within distinct null asc desc nulls with interval exists any all using fetch".split())
_TYPES = {"integer": "int", "text": "string", "varchar": "string", "long": "bigint", "real": "float", "bool": "boolean"}
#: Aggregates that are no measures: beside a measure they make the statement one a rollup cannot answer.
_OTHER_AGGREGATES = frozenset("stddev stddev_samp stddev_pop variance var_samp var_pop percentile_cont percentile_disc percentile median mode corr first last collect_list collect_set approx_count_distinct bool_or bool_and any_value max_by min_by".split())


class _Reader:
    def __init__(self, sql: str) -> None:
        self.toks: list[tuple[str, str]] = []
        for m in _TOKEN.finditer(sql):
            if m.lastgroup == "other":
                raise Declined(f"character {m.group()!r}")
            if m.lastgroup:
                t = m.group()
                self.toks.append(("word", t.lower()) if m.lastgroup == "word" else ("name", t[1:-1].lower()) if m.lastgroup == "quoted" else (m.lastgroup, t))
        while self.toks and self.toks[-1] == ("op", ";"):
            self.toks.pop()
        self.at = 0
        self.nested = 0  # aggregates met inside an expression that is no measure itself

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.toks[self.at + ahead] if self.at + ahead < len(self.toks) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, t = self.peek()
        if kind in ("word", "op") and t in values:
            self.at += 1
            return t
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise Declined(f"expected {value}, found {self.peek()[1] or 'the end'}")

    # an expression gives (key, is it an operation that brackets must keep together)
    def condition(self) -> tuple[str, bool]:
        left = self.negation()
        if self.peek() == ("word", "or"):
            raise Declined("OR")
        while self.take("and"):
            left = (f"{_w(left)} and {_w(self.negation())}", True)
            if self.peek() == ("word", "or"):
                raise Declined("OR")
        return left

    def negation(self) -> tuple[str, bool]:
        if self.take("not"):
            return f"not ({self.negation()[0]})", False
        return self.comparison()

    def comparison(self) -> tuple[str, bool]:
        left = self.sum()
        op = self.take("=", "<>", "!=", "<", "<=", ">", ">=", "<=>")
        if op:
            return f"{_w(left)} {'<>' if op == '!=' else op} {_w(self.sum())}", False
        no = self.take("not")
        if self.take("between"):
            low = self.sum()[0]
            self.need("and")
            out = f"{_w(left)} between {low} and {self.sum()[0]}"
        elif self.take("in"):
            self.need("(")
            if self.peek() == ("word", "select"):
                raise Declined("subquery")
            items = [self.sum()[0]]
            while self.take(","):
                items.append(self.sum()[0])
            self.need(")")
            out = f"{_w(left)} in ({', '.join(items)})"
        elif not no and self.take("is"):
            no_null = self.take("not")
            self.need("null")
            return f"{_w(left)} is {'not ' if no_null else ''}null", False
        elif no:
            raise Declined("expression")
        else:
            return left
        return (f"not ({out})", False) if no else (out, False)

    def sum(self) -> tuple[str, bool]:
        left = self.product()
        while op := self.take("+", "-"):
            left = (f"{_w(left)} {op} {_w(self.product())}", True)
        return left

    def product(self) -> tuple[str, bool]:
        left = self.unary()
        while op := self.take("*", "/", "%"):
            left = (f"{_w(left)} {op} {_w(self.unary())}", True)
        return left

    def unary(self) -> tuple[str, bool]:
        if self.take("-"):
            return "-" + _w(self.unary()), False
        return self.cast()

    def cast(self) -> tuple[str, bool]:
        left = self.primary()
        while self.take("::"):
            kind, t = self.peek()
            if kind != "word":
                raise Declined("type")
            self.at += 1
            if t in ("numeric", "decimal") or self.peek() == ("op", "("):
                raise Declined("type")
            left = (f"{_w(left)}::{_TYPES.get(t, t)}", False)
        return left

    def primary(self) -> tuple[str, bool]:
        kind, t = self.peek()
        if kind == "text":
            self.at += 1
            return t, False
        if kind == "number":
            self.at += 1
            return t, False
        if self.take("("):
            if self.peek() == ("word", "select"):
                raise Declined("subquery")
            inner = self.condition()
            self.need(")")
            return inner
        if kind == "word" and t in _STOP and t != "null":
            raise Declined(f"expression {t}")
        if kind == "word" and t == "null":
            self.at += 1
            return "null", False
        if kind not in ("word", "name"):
            raise Declined(f"expression {t or 'missing'}")
        self.at += 1
        if kind == "word" and self.peek() == ("op", "("):
            return self.call(t), False
        if kind == "word" and self.peek()[0] == "text":
            raise Declined("typed literal")
        while self.take("."):
            kind, t = self.peek()
            if kind not in ("word", "name"):
                raise Declined("expression")
            self.at += 1
        return t, False

    def call(self, name: str) -> str:
        if name in ("extract", "cast", "try_cast", "trim", "position", "substring", "overlay"):
            raise Declined(name)
        self.need("(")
        distinct = bool(self.take("distinct"))
        args: list[str] = []
        if self.take("*"):
            args = ["*"]
        elif self.peek() != ("op", ")"):
            args = [self.condition()[0]]
            while self.take(","):
                args.append(self.condition()[0])
        self.need(")")
        if self.peek() in (("word", "over"), ("word", "filter"), ("word", "within")):
            raise Declined(self.peek()[1].upper() + " clause")
        if name in MEASURES or name in _OTHER_AGGREGATES:
            self.nested += 1
        if name == "count" and args in (["*"], ["1"]) and not distinct:
            return "count(*)"
        if args == ["*"]:
            raise Declined("expression *")
        return f"{name}({'distinct ' if distinct else ''}{', '.join(args)})"


def _w(e: tuple[str, bool]) -> str:
    return f"({e[0]})" if e[1] else e[0]


def _conjuncts(r: _Reader) -> list[str]:
    """Parts of a condition; brackets around a conjunction are opened."""
    out = []
    while True:
        if r.peek() == ("op", "("):
            mark = r.at
            r.at += 1
            try:
                inner = _conjuncts(r)
                r.need(")")
                if r.peek()[0] == "end" or r.peek() in (("word", "and"), ("op", ")")) or (r.peek()[0] == "word" and r.peek()[1] in ("group", "order", "limit", "offset")):
                    out += inner
                else:
                    raise Declined("again")
            except Declined as e:
                if str(e) in ("OR", "subquery"):
                    raise
                r.at = mark
                out.append(r.negation()[0])
        else:
            out.append(r.negation()[0])
        if r.peek() == ("word", "or"):
            raise Declined("OR")
        if not r.take("and"):
            return out


def shape_of(sql: str | None) -> Shape:
    """The strict shape of a statement; raises Declined."""
    if not sql or not sql.strip():
        raise Declined("empty statement")
    r = _Reader(sql)
    r.need("select")
    if r.peek() == ("word", "distinct"):
        raise Declined("SELECT DISTINCT")
    order: list[str | None] = []
    names: dict[str, str | None] = {}
    measures: list[str] = []
    while True:
        if r.peek() == ("op", "*"):
            raise Declined("SELECT *")
        begin, before = r.at, r.nested
        k = r.condition()[0]
        bare = r.peek(begin - r.at)[0] == "word" and r.peek(begin - r.at)[1] in MEASURES and k.startswith(r.peek(begin - r.at)[1] + "(") and r.nested == before + 1 and k.endswith(")") and _one_call(k)
        if r.nested > before and not bare:
            raise Declined("aggregate inside an expression")
        alias = None
        if r.take("as") or (r.peek()[0] in ("word", "name") and r.peek()[1] not in _STOP):
            alias = r.peek()[1]
            r.at += 1
        if bare:
            measures.append(k)
        order.append(None if bare else k)
        if alias:
            names[alias] = order[-1]
        if not r.take(","):
            break
    if not measures:
        raise Declined("no measure")
    r.need("from")
    parts = []
    while True:
        kind, t = r.peek()
        if kind not in ("word", "name") or (kind == "word" and t in _STOP):
            raise Declined("source")
        parts.append(t)
        r.at += 1
        if not r.take("."):
            break
    r.take("as")
    if r.peek()[0] in ("word", "name") and r.peek()[1] not in _STOP:
        r.at += 1
    filters = _conjuncts(r) if r.take("where") else []
    groups: list[str] = []
    if r.take("group"):
        r.need("by")
        while True:
            before = r.nested
            k = r.sum()[0]
            if k.isdigit():
                if not 0 < int(k) <= len(order) or order[int(k) - 1] is None:
                    raise Declined("group key is a measure")
                k = order[int(k) - 1]
            elif k in names:
                if names[k] is None:
                    raise Declined("group key is a measure")
                k = names[k]
            elif r.nested > before:
                raise Declined("group key is a measure")
            groups.append(k)
            if not r.take(","):
                break
    if r.take("order"):
        r.need("by")
        while True:
            r.sum()
            r.take("asc", "desc")
            if r.take("nulls"):
                r.at += 1
            if not r.take(","):
                break
    for word in ("limit", "offset"):
        if r.take(word):
            if r.peek()[0] != "number" and r.peek() != ("word", "all"):
                raise Declined(word)
            r.at += 1
    if r.peek()[0] != "end":
        raise Declined(f"after the statement: {r.peek()[1]}")
    for k in order:
        if k is not None and k not in groups:
            raise Declined("select item is not grouped")
    eq = [m[1] for m in (re.match(r"([a-z_]\w*) = ", f) for f in filters) if m]
    return Shape(".".join(parts), tuple(sorted(set(measures))), tuple(sorted(set(groups))), tuple(sorted(filters)), tuple(dict.fromkeys(eq)))


def _one_call(k: str) -> bool:
    """Whether a key is one call from its first bracket to its end."""
    depth = 0
    for i, ch in enumerate(k):
        depth += (ch == "(") - (ch == ")")
        if depth == 0 and ch == ")" and i < len(k) - 1:
            return False
    return True


SHAPED = "shape_id long, table string, measures array<string>, groupby array<string>, filters array<string>, eq_cols array<string>, reason string"


def _map(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i, sql in zip(pdf["i"], pdf["sql"]):
            try:
                s = shape_of(sql if isinstance(sql, str) else None)
                out.append((i, s.table, list(s.measures), list(s.groupby), list(s.filters), list(s.eq_cols), None))
            except Declined as e:
                out.append((i, None, None, None, None, None, str(e)))
        yield pd.DataFrame(out, columns=["shape_id", "table", "measures", "groupby", "filters", "eq_cols", "reason"])


def shapes(df: DataFrame, statement: str, key: str) -> DataFrame:
    """A row a statement: its shape, or the reason it was declined (:data:`SHAPED`; shape_id is the key)."""
    return df.select(F.col(key).cast("long").alias("i"), F.col(statement).alias("sql")).mapInPandas(_map, SHAPED)
