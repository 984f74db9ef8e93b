"""Statement fingerprints: exact text, normalized text, resolved plan; and hashes of results."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters of a hash that are kept.
KEEP = 12
#: Words that cannot be a table's alias.
RESERVED = frozenset(("where", "group", "order", "limit", "on", "join", "left", "inner", "having"))
#: A word or one other character, with the blanks before it.
_TOKEN = re.compile(r"([\s\ufeff]*)([A-Za-z0-9_]+|[^A-Za-z0-9_\s\ufeff])")
_NAME = re.compile(r"[a-z_][a-z0-9_]*")


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def exact_hash(c: Column) -> Column:
    return F.substring(F.sha1(trimmed(c)), 1, KEEP)


def without_comments(c: Column) -> Column:
    """Block and line comments become a blank; literals are not spared."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


Token = tuple[str, str]  # the blank before a word (one or none), the word


def lex(text: str) -> list[Token]:
    return [(" " if gap else "", word) for gap, word in _TOKEN.findall(text)]


def _text(tokens: list[Token]) -> str:
    return "".join(gap + word for gap, word in tokens).strip()


def _parts(tokens: list[Token]) -> list[list[Token]]:
    """The parts of a condition between ANDs outside brackets."""
    parts: list[list[Token]] = [[]]
    depth = 0
    for i, (gap, word) in enumerate(tokens):
        depth += (word == "(") - (word == ")")
        if depth == 0 and word.lower() == "and" and gap and i + 1 < len(tokens) and tokens[i + 1][0]:
            parts.append([])
        else:
            parts[-1].append((gap, word))
    return [p for p in parts if p]


def conjuncts(text: str) -> list[str]:
    """The parts of a condition between ANDs outside brackets, as text."""
    return [_text(p) for p in _parts(lex(text))]


def _without_aliases(tokens: list[Token]) -> list[Token]:
    """Table aliases left out, and their table's name put where they stand before a dot."""
    table_of: dict[str, str] = {}
    kept, upto = [], 0
    for i in [i for i, t in enumerate(tokens[:-2], 1) if t[1] == "from" or t[1] == "join"]:
        gap, name = tokens[i]
        j = i + 1 + (tokens[i + 1] == (" ", "as"))
        if i < upto or not gap or not _NAME.fullmatch(name) or j >= len(tokens):
            continue
        gap, alias = tokens[j]
        if gap and _NAME.fullmatch(alias) and alias not in RESERVED and not (j + 1 < len(tokens) and tokens[j + 1][1] == "("):
            table_of[alias] = name
            kept += tokens[upto : i + 1]
            upto = j + 1
    if not table_of:
        return tokens
    kept += tokens[upto:]
    for i, t in enumerate(kept[1:]):
        if t == ("", ".") and kept[i][1] in table_of:
            kept[i] = (kept[i][0], table_of[kept[i][1]])
    return kept


def _by_comma(body: list[Token]) -> str:
    """Items between commas (those in brackets, too) in order."""
    return ", ".join(sorted(x.strip() for x in _text(body).split(",")))


#: How the body of a clause is written; bodies of other clauses stay as they are.
_BODY = {"select": _by_comma, "where": lambda body: " and ".join(sorted(map(_text, _parts(body)))), "group by": _by_comma}


_OPENING = frozenset(("from", "where", "group", "order", "limit", "having"))


def _clauses(tokens: list[Token]) -> list[tuple[str, str, list[Token]]]:
    """(blank before, opening words, body) of the outermost clauses; "" opens what is left as it stands."""
    at: list[tuple[int, str, int]] = [(0, "", 0)]  # where a clause begins, what opens it, where its body begins
    if tokens and tokens[0][1] == "select":
        at.append((0, "select", 1))
    seen: set[str] = set()
    for i in [i for i, t in enumerate(tokens) if t[1] in _OPENING]:
        gap, word = tokens[i]
        now, two = at[-1][1], f"{word} {tokens[i + 1][1]}" if i + 1 < len(tokens) and tokens[i + 1][0] else ""
        if now == "select":
            if word == "from" and gap:
                at.append((i, "from", i + 1))
        elif word == "where" and not seen:
            at.append((i, "where", i + 1))
        elif two == "group by" and two not in seen:
            at.append((i, two, i + 2))
        elif now in ("where", "group by") and (word in ("limit", "having") or two == "order by"):
            at.append((i, "", i))
        seen |= {at[-1][1]} & {"where", "group by"}
    ends = [begin for begin, _, _ in at[1:]] + [len(tokens)]
    return [(tokens[i][0] if i < len(tokens) else "", opened, tokens[body:end]) for (i, opened, body), end in zip(at, ends)]


def normalize(sql: str) -> str:
    """Text normal form: no comments, one blank, lower case (literals too), no table aliases, sorted conjuncts and lists.

    Literals are read like the rest of the text. The form is the text two statements must share to count as one, not a
    statement that could be run: items are cut at every comma.
    """
    tokens = lex(re.sub(r"--[^\n]*", " ", re.sub(r"/\*.*?\*/", " ", sql, flags=re.S)).lower())
    if tokens and tokens[-1][1] == ";":
        tokens.pop()
    clauses = _clauses(_without_aliases(tokens))
    if clauses[-1][1] == "select":  # a list without FROM stays as it stands
        return _text([("", "select"), *clauses[-1][2]])
    out = ""
    for n, (gap, opened, body) in enumerate(clauses):
        after = n and clauses[n - 1][1] in _BODY
        written = f"{opened} {_BODY[opened](body)}" if opened in _BODY else opened + "".join(g + w for g, w in body)
        out += (" " if after else gap) + (written if opened else written.lstrip())
    return " ".join(out.split())


def _normalize_series(s: pd.Series) -> pd.Series:
    code, texts = pd.factorize(s)  # a statement that comes again in a batch is read once
    forms = np.array([normalize(t) for t in texts] + [None], dtype=object)
    return pd.Series(forms[code], index=s.index)


def normalized(c: Column) -> Column:
    return F.pandas_udf(_normalize_series, "string")(c)


def normalized_hash(c: Column) -> Column:
    return F.substring(F.sha1(normalized(c)), 1, KEEP)


def semantic_hash(spark, sql: str) -> int:
    """A hash of the resolved plan: equal for statements that differ in aliases and predicate order. Tables must exist."""
    return spark.sql(sql).semanticHash()


def result_hash(rows: list[dict]) -> str:
    """Hash of a result in its order."""
    return hashlib.sha1(json.dumps(rows, separators=(",", ":"), default=str, ensure_ascii=False).encode()).hexdigest()[:KEEP]


def unordered_hash(row: Column) -> Column:
    """Hash of all rows whatever their order: an aggregate that moves one number a task, not the rows. row: a struct."""
    h = F.xxhash64(F.to_json(row))
    return F.substring(F.sha1(F.concat_ws(",", F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h))), 1, KEEP)


def unordered_result_hash(df: DataFrame) -> Column:
    """:func:`unordered_hash` of the rows of ``df``."""
    return unordered_hash(F.struct(*df.columns))
