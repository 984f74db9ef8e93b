"""Trace context on the wire: the comment before a statement and the tag of a session, as column functions.

Fixed values: the comment opens with ``/*agenttrace:`` and holds comma-joined pairs with the keys below, values
percent-encoded, ``-`` for an absent parent or retry; the tag is JSON with a subset of the keys.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wire keys and the fields they carry.
KEYS = {"t": "trace_id", "s": "span_id", "p": "parent_span_id", "a": "agent_id", "m": "model_id", "c": "speculation_class", "n": "attempt_n", "r": "retry_of", "i": "span_intent"}
TAG_KEYS = ("t", "s", "p", "a", "c", "i")
CLASSES = ("probe", "refine", "final")
INTENT_CHARS, TAG_CHARS = 300, 2000
STRICT, LENIENT = r"/\*agenttrace:([^*]*)\*/", r"/\*agenttrace:(.*?)\*/"


def encode(c: Column) -> Column:
    """Percent-encoding that leaves no blank, plus or asterisk."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def comment(fields: dict[str, Column]) -> Column:
    """The comment that carries the given fields; a null parent or retry becomes ``-``, other nulls are left out."""
    pairs = []
    for key, name in KEYS.items():
        if name in fields:
            value = encode(fields[name].cast("string"))
            pairs.append(F.concat(F.lit(f"{key}="), F.coalesce(value, F.lit("-")) if key in "pr" else value))
    return F.concat(F.lit("/*agenttrace:"), F.concat_ws(",", *pairs), F.lit("*/"))


def decode(c: Column) -> Column:
    """The inverse of :func:`encode`; a percent sign that begins no escape and a plus sign stand for themselves."""
    return F.try_url_decode(F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def parse(sql: Column, strict: bool = False) -> Column:
    """The context of a statement as a struct, null where there is none.

    strict: the comment's body may hold no asterisk (a span whose intent has a bare one is then lost).
    """
    body = F.regexp_extract(sql, STRICT if strict else LENIENT, 1)
    pairs = F.filter(F.split(body, ","), lambda x: x.contains("="))
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substr(x, F.instr(x, "=") + 1).alias("v")))
    # the last pair of a key wins
    def value(key: str) -> Column:
        mine = F.filter(entries, lambda e: e["k"] == key)
        return F.try_element_at(mine, F.lit(-1))["v"]

    cols = []
    for key, name in KEYS.items():
        raw = value(key)
        text = decode(raw)
        if key in "pr":
            text = F.when(text != "-", text)
        cols.append((text.try_cast("int") if key == "n" else text).alias(name))
    return F.when(sql.rlike(STRICT if strict else LENIENT), F.struct(*cols))


def strip(sql: Column) -> Column:
    """The statement without its first context comment and the blanks after it."""
    return F.when(sql.rlike(LENIENT), F.regexp_replace(sql, r"(?s)^(.*?)/\*agenttrace:.*?\*/\s*(.*)$", "$1$2")).otherwise(sql)


def intent_text(c: Column) -> Column:
    """An intent as a tag may hold it: quotes, backslashes and control characters blanked, blanks squeezed, cut to length."""
    t = F.regexp_replace(c, "['\"\\\\\\x00-\\x1f\\x7f]", " ")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, INTENT_CHARS)


def tag(fields: dict[str, Column]) -> Column:
    """The session tag, JSON with explicit nulls, cut to its greatest length."""
    cols = [(intent_text(fields[KEYS[k]]) if k == "i" else fields[KEYS[k]]).alias(k) for k in TAG_KEYS if KEYS[k] in fields]
    return F.substring(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 1, TAG_CHARS)


def parse_tag(c: Column) -> Column:
    """The fields of a tag, null unless it is JSON with a trace id."""
    j = F.from_json(c, ", ".join(f"{k} string" for k in TAG_KEYS))
    return F.when(j["t"].isNotNull() & (j["t"] != ""), F.struct(*[j[k].alias(KEYS[k]) for k in TAG_KEYS]))


def set_tag_sql(tag_text: str) -> str:
    """The statement that sets a session's tag; single quotes doubled."""
    return "ALTER SESSION SET QUERY_TAG = '" + tag_text.replace("'", "''") + "'"


def class_of(follows: Column) -> Column:
    """refine when a span follows another, else probe."""
    return F.when(follows.isNotNull() & (follows != ""), "refine").otherwise("probe")


@dataclass(frozen=True)
class Trace:
    """One task of one agent."""
    agent_id: str
    model_id: str | None = None
    task_intent: str | None = None
    trace_id: str = field(default_factory=lambda: secrets.token_hex(8))


@dataclass(frozen=True)
class Span:
    """One statement of a trace."""
    trace: Trace
    span_intent: str
    speculation_class: str = "probe"
    parent_span_id: str | None = None
    attempt_n: int = 1
    retry_of: str | None = None
    span_id: str = field(default_factory=lambda: secrets.token_hex(6))

    def __post_init__(self) -> None:
        if self.speculation_class not in CLASSES:
            raise ValueError(f"speculation_class must be one of {CLASSES}")

    def retry(self) -> Span:
        return replace(self, attempt_n=self.attempt_n + 1, retry_of=self.span_id, span_id=secrets.token_hex(6))

    def columns(self) -> dict[str, Column]:
        return {"trace_id": F.lit(self.trace.trace_id), "span_id": F.lit(self.span_id), "parent_span_id": F.lit(self.parent_span_id).cast("string"),
                "agent_id": F.lit(self.trace.agent_id), "model_id": F.lit(self.trace.model_id).cast("string"), "speculation_class": F.lit(self.speculation_class),
                "attempt_n": F.lit(self.attempt_n), "retry_of": F.lit(self.retry_of).cast("string"), "span_intent": F.lit(self.span_intent)}
