"""Semi-structured log lines into entries with timestamp, level, component and message.

A deterministic state machine reads every line character by character: a layout is a list of states, each of which
accepts characters of one class (digits, a word, a quoted run, a run up to a delimiter) and hands over to the next. The
layouts of a database server's ``log_line_prefix`` settings are compiled from the setting itself
(:func:`compile_prefix`), those of other programs are written in the same notation. A line that runs through all
states of a layout begins a record; any other line continues the record before it (the look-ahead that attaches
continuations). While a quoted cell of a csv record is open, every line continues it, even one that looks like a record;
only a further csv record ends it (its quotes would be doubled inside a cell). JSON records, on one line or spread over
many, are read by a second machine that keeps depth, string and escape state, so only keys of the outermost object count.

Scale: lines are range-partitioned by (log, line number), so the largest log is cut into as many pieces as its size
asks for, and each piece is scanned once in order. A piece does not know whether it begins inside a quoted cell; it notes
up to which line that would matter, and what it found before that line counts only if it does not. Only the records that
touch the edge of a piece (at most two a piece) are joined up again, by log, from a few numbers a piece.

Defined results
---------------
* one row per record with the first and last line number; repeated (log, line number) pairs count once;
* lines before the first record of a log, and so all lines of a log of no known layout, belong to no record; with
  ``unknown`` they come as rows of their own, layout and level null (one row a piece at most);
* level is one of debug, info, notice, warning, error, critical, fatal, panic, alert, emergency, statement, detail,
  hint, context, log; null when the record states none; timestamp is UTC where the zone is known, else as written;
* rows without log id or line number are ignored; a null line is an empty line; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut

#: The settings of log_line_prefix that are recognised.
PREFIXES = ("%m [%p] ", "%t [%p]: user=%u,db=%d,app=%a ", "%n [%p-%l] %u@%d ", "<%m %c %e> ")
#: Levels by the words and letters programs write, and what they mean.
LEVELS = {
    "debug": "debug", "debug1": "debug", "debug2": "debug", "debug3": "debug", "debug4": "debug", "debug5": "debug", "trace": "debug", "d": "debug",
    "info": "info", "i": "info", "log": "log", "notice": "notice", "n": "notice", "warn": "warning", "warning": "warning", "w": "warning",
    "error": "error", "err": "error", "e": "error", "critical": "critical", "crit": "critical", "c": "critical", "fatal": "fatal", "f": "fatal",
    "panic": "panic", "p": "panic", "alert": "alert", "a": "alert", "emerg": "emergency", "emergency": "emergency",
    "statement": "statement", "detail": "detail", "hint": "hint", "context": "context", "query": "detail", "location": "context",
}
#: Syslog severities (priority modulo 8) and numeric levels of JSON loggers.
SYSLOG = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
NUMERIC = {10: "debug", 20: "debug", 30: "info", 40: "warning", 50: "error", 60: "fatal"}
#: Levels that are an error or worse.
SEVERE = ("error", "critical", "fatal", "panic", "alert", "emergency")
#: Zone abbreviations and their offsets in hours.
ZONES = {"UTC": 0, "GMT": 0, "Z": 0, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "JST": 9}
MONTHS = {m: i + 1 for i, m in enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"))}

DIGITS, HEX, ALPHA = frozenset("0123456789"), frozenset("0123456789abcdef"), frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
WORD = ALPHA | DIGITS | frozenset("_")
DOTTED = WORD | frozenset(".-")

# A state is ("lit", text) | ("run", field or "", class, least, most) | ("to", field, stops) | ("quoted", field) | ("rest", field)


def _lit(text: str) -> tuple:
    return ("lit", text)


def _n(field: str, least: int, most: int | None = None) -> tuple:
    return ("run", field, DIGITS, least, most or least)


def _stamp(field: str, sep: str, frac: str) -> list[tuple]:
    out = [("mark", field), _n("", 4), _lit("-"), _n("", 2), _lit("-"), _n("", 2), _lit(sep), _n("", 2), _lit(":"), _n("", 2), _lit(":"), _n("", 2)]
    if frac:
        out += [_lit(frac), _n("", 1, 9)]
    return out + [("keep", field)]


_ZONE = ("run", "zone", ALPHA | DIGITS | frozenset("+-:"), 1, 6)
_LEVEL = ("run", "level", WORD, 1, 12)
#: The states each escape of a log_line_prefix stands for.
ESCAPES = {
    "m": [*_stamp("ts", " ", "."), _lit(" "), _ZONE], "t": [*_stamp("ts", " ", ""), _lit(" "), _ZONE],
    "n": [("mark", "epoch"), _n("", 9, 11), _lit("."), _n("", 3), ("keep", "epoch")],
    "p": [_n("pid", 1, 10)], "l": [_n("", 1, 12)], "e": [("run", "", WORD, 5, 5)], "c": [("run", "", HEX, 1, 16), _lit("."), ("run", "", HEX, 1, 16)],
    "u": [("to", "user")], "d": [("to", "db")], "a": [("to", "component")], "h": [("to", "")], "r": [("to", "")], "%": [_lit("%")],
    "s": [*_stamp("", " ", ""), _lit(" "), ("run", "", ALPHA | DIGITS | frozenset("+-:"), 1, 6)], "i": [("to", "")], "b": [("to", "")], "L": [("to", "")],
    "P": [_n("", 0, 10)], "v": [("run", "", DIGITS | frozenset("/"), 0, 30)], "x": [_n("", 1, 20)], "Q": [("run", "", DIGITS | frozenset("-"), 1, 20)],
}
_PAD = ("run", "", frozenset(" "), 0, 200)


def compile_prefix(prefix: str) -> list[tuple]:
    """The states of a server line written under ``log_line_prefix = prefix``: the prefix, ``LEVEL:  `` and the message.

    A width (``%-10u``) allows blanks on both sides; ``%q`` writes nothing; an escape the server does not know stands for itself.
    """
    states: list[tuple] = []
    i = 0
    while i < len(prefix):
        j = i + 1
        while prefix[i] == "%" and j < len(prefix) and prefix[j] in "-0123456789":
            j += 1
        if prefix[i] == "%" and j < len(prefix) and (prefix[j] in ESCAPES or prefix[j] == "q"):
            body = ESCAPES.get(prefix[j], [])
            states += [_PAD, *body, _PAD] if j > i + 1 else body
            i = j + 1
        else:
            states.append(_lit(prefix[i]))
            i += 1
    return states + [_LEVEL, _lit(":  "), ("rest", "message")]


#: Layouts of other programs: connection pooler, csv, standard-library logger, syslog, bracketed.
LAYOUTS: dict[str, list[tuple]] = {
    "pooler": [*ESCAPES["m"], _lit(" ["), _n("pid", 1, 10), _lit("] "), _LEVEL, _lit(" "), ("run", "component", ALPHA, 1, 1), _lit("-0x"), ("run", "", HEX, 1, 16), _lit(": "), ("rest", "message")],
    "csv": [*ESCAPES["m"], _lit(","), ("cell", "user"), _lit(","), ("cell", "db"), _lit(","), _n("pid", 1, 10), _lit(","), ("cell", ""), _lit(","), _LEVEL, _lit(","), ("run", "", WORD, 5, 5), _lit(","), ("rest", "message")],
    "logger": [*_stamp("ts", " ", ","), _lit(" - "), ("run", "component", DOTTED, 1, 80), _lit(" - "), _LEVEL, _lit(" - "), ("rest", "message")],
    "syslog": [_lit("<"), _n("pri", 1, 3), _lit(">"), _n("", 1, 2), _lit(" "), *_stamp("ts", "T", "."), _ZONE, _lit(" "), ("to", ""), _lit(" "), ("to", "component"), _lit(" "), ("to", ""), _lit(" "), ("to", ""), _lit(" "), ("to", ""), _lit(" "), ("rest", "message")],
    "bracket": [_lit("["), ("mark", "clf"), _n("", 2), _lit("/"), ("run", "", ALPHA, 3, 3), _lit("/"), _n("", 4), _lit(":"), _n("", 2), _lit(":"), _n("", 2), _lit(":"), _n("", 2), _lit(" "), ("run", "", DIGITS | frozenset("+-"), 5, 5), ("keep", "clf"), _lit("] ("), ("run", "level", ALPHA, 1, 1), _lit(") "), ("run", "component", DOTTED, 1, 80), _lit(": "), ("rest", "message")],
}


def _first(states: list[tuple]) -> str:
    """What a line of the layout begins with: a character, "0" for a digit, "" for anything."""
    head = next((x for x in states if x[0] not in ("mark", "keep")), ("rest",))
    return head[1][0] if head[0] == "lit" else "0" if head[0] == "run" and head[2] <= DIGITS and head[3] else ""


Machine = dict[str, list[tuple[str, list[tuple]]]]


def machine(prefixes: Iterable[str] = PREFIXES) -> Machine:
    """The layouts by what their lines begin with; a prefix with ``%q`` gives two, as some processes stop there."""
    all_ = dict(LAYOUTS)
    for p in prefixes:
        all_ |= {f"prefix {x}": compile_prefix(x) for x in dict.fromkeys((p, p.split("%q")[0]))}
    out: Machine = {}
    for name, states in all_.items():
        out.setdefault(_first(states), []).append((name, states))
    return out


def run(states: list[tuple], line: str) -> dict[str, str] | None:
    """Run a line through the states; the fields, or None as soon as a character does not fit."""
    got: dict[str, str] = {}
    at, n, marks = 0, len(line), {}
    for i, s in enumerate(states):
        kind = s[0]
        if kind == "lit":
            if not line.startswith(s[1], at):
                return None
            at += len(s[1])
        elif kind == "run":
            _, field, chars, least, most = s
            end = at
            while end < n and end - at < most and line[end] in chars:
                end += 1
            if end - at < least:
                return None
            if field:
                got[field] = line[at:end]
            at = end
        elif kind == "to":  # a free run up to the literal of the next state; for the last one before a level, to the level
            padded = states[i + 1] is _PAD
            nxt = states[i + 1 + padded]
            end = line.find(nxt[1], at) if nxt[0] == "lit" else at
            if end < 0:
                return None
            if s[1] == "component" and nxt[0] == "lit" and i + 2 < len(states) and states[i + 2] is _LEVEL:
                colon = line.find(":  ", at)  # an application name may hold spaces: the level is the word before ":  "
                if colon < 0:
                    return None
                end = line.rfind(nxt[1], at, colon)
                if end < 0:
                    return None
            if s[1]:
                got[s[1]] = line[at:end].rstrip(" ") if padded else line[at:end]
            at = end
        elif kind == "cell":  # a csv cell, quoted or bare
            if at < n and line[at] == '"':
                end = at + 1
                while end < n and line[end] != '"':
                    end += 1
                if end >= n:
                    return None
                value, at = line[at + 1 : end], end + 1
            else:
                end = at
                while end < n and line[end] not in ',"':
                    end += 1
                value, at = line[at:end], end
            if s[1]:
                got[s[1]] = value
        elif kind == "mark":
            marks[s[1]] = at
        elif kind == "keep":
            got[s[1]] = line[marks[s[1]] : at]
        else:
            got[s[1]] = line[at:]
            at = n
    level = got.get("level")
    if level is not None and level.lower() not in LEVELS:
        return None
    return got


def logfmt(line: str) -> dict[str, str] | None:
    """The pairs of a line that is key=value all through and holds a level and a time or message, else None."""
    out: dict[str, str] = {}
    at, n = 0, len(line)
    while at < n:
        end = at
        while end < n and line[end] in DOTTED:
            end += 1
        if end == at or end >= n or line[end] != "=":
            return None
        key, at = line[at:end], end + 1
        if at < n and line[at] == '"':
            at += 1
            piece = []
            while at < n and line[at] != '"':
                if line[at] == "\\" and at + 1 < n:
                    at += 1
                    piece.append({"n": "\n", "t": "\t"}.get(line[at], line[at]))
                else:
                    piece.append(line[at])
                at += 1
            value, at = "".join(piece), at + 1
        else:
            end = at
            while end < n and line[end] != " ":
                end += 1
            value, at = line[at:end], end
        out.setdefault(key, value)
        if at < n and line[at] != " ":
            return None
        while at < n and line[at] == " ":
            at += 1
    if not ({"level", "lvl", "severity"} & out.keys() and {"ts", "time", "t", "msg", "message"} & out.keys()):
        return None
    return out


class Json:
    """Reads an object over any number of lines; keeps the scalar pairs of the outermost object."""

    def __init__(self) -> None:
        self.depth, self.string, self.escape = 0, False, False
        self.out: dict[str, str] = {}
        self.key: str | None = None
        self.buf: list[str] = []
        self.value = False
        self.over = self.bad = False

    def _end(self) -> None:
        text = "".join(self.buf).strip()
        if self.depth == 1 and self.value and self.key is not None and text:
            self.out.setdefault(self.key, text)
        self.buf = []

    def feed(self, text: str) -> None:
        for ch in text:
            if self.over:
                self.bad = self.bad or not ch.isspace()
            elif self.string:
                if self.escape:
                    self.escape = False
                    self.buf.append({"n": "\n", "t": "\t", "r": "\r"}.get(ch, ch))
                elif ch == "\\":
                    self.escape = True
                elif ch == '"':
                    self.string = False
                    if self.depth == 1 and not self.value:
                        self.key, self.buf = "".join(self.buf), []
                else:
                    self.buf.append(ch)
            elif ch == '"':
                self.string, self.buf = True, []
            elif ch == ":" and self.depth == 1:
                self.value, self.buf = True, []
            elif ch in "{[":
                self.depth += 1
                self.buf = []
            elif ch in "}],":
                self._end()
                if ch != ",":
                    self.depth -= 1
                if self.depth == 1:
                    self.value = False
                    self.key = None
                self.over = self.depth <= 0
            else:
                self.buf.append(ch)


MACHINE = machine()


def begin(line: str, layouts: Machine = MACHINE) -> tuple[str, dict[str, str]] | None:
    """The layout of the record a line begins, with its fields; None for a line that continues one."""
    if not line:
        return None
    ch = line[0]
    if ch == "{":
        if line.rstrip() == "{":
            return "json", {}
        j = Json()
        j.feed(line)
        keys = j.out.keys()
        if j.over and not j.bad and {"level", "severity", "lvl"} & keys and {"msg", "message", "ts", "time"} & keys:
            return "json", {}
        return None
    for name, states in (*layouts.get("0" if ch in DIGITS else ch, ()), *layouts.get("", ())):
        got = run(states, line)
        if got is not None:
            return name, got
    if ch in ALPHA and "=" in line:
        got = logfmt(line)
        if got is not None:
            return "pairs", got
    return None


def _utc(text: str, zone: str) -> datetime | None:
    """A written time as naive UTC."""
    try:
        t = datetime.fromisoformat(text.replace(",", ".").replace("T", " "))
    except ValueError:
        return None
    if zone[:1] in "+-" and zone[1:3].isdigit():
        return t - (1 if zone[0] == "+" else -1) * timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]) if len(zone) > 3 else 0)
    return t - timedelta(hours=ZONES.get(zone, 0))


def _cell(text: str) -> str:
    """The first csv cell of a text: quotes removed, doubled quotes halved."""
    if not text.startswith('"'):
        return text.split(",", 1)[0]
    at, piece = 1, []
    while at < len(text):
        if text[at] == '"':
            if text[at + 1 : at + 2] != '"':
                break
            at += 1
        piece.append(text[at])
        at += 1
    return "".join(piece)


def _when(f: dict[str, str]) -> datetime | None:
    try:
        if "epoch" in f:
            return datetime.fromtimestamp(float(f["epoch"]), timezone.utc).replace(tzinfo=None)
        if "clf" in f:
            d = f["clf"]
            z = d[-5:]
            t = datetime(int(d[7:11]), MONTHS[d[3:6]], int(d[:2]), int(d[12:14]), int(d[15:17]), int(d[18:20]))
            return t - (1 if z[0] == "+" else -1) * timedelta(hours=int(z[1:3]), minutes=int(z[3:]))
        raw = f.get("ts") or f.get("time") or f.get("t")
        if raw is None:
            return None
        if raw.isdigit():
            return datetime.fromtimestamp(int(raw) / (1000 if len(raw) > 11 else 1), timezone.utc).replace(tzinfo=None)
        if raw.endswith("Z"):
            return _utc(raw[:-1], "UTC")
        return _utc(raw, f.get("zone", ""))
    except (ValueError, KeyError, OverflowError, OSError):
        return None


def fields(kind: str, f: dict[str, str], lines: list[str]) -> tuple[datetime | None, str | None, str | None, str]:
    """Timestamp, level, component and message of a record."""
    if kind == "json":
        j = Json()
        for x in lines:
            j.feed(x + "\n")
            if j.over:
                break
        f = j.out
    raw = f.get("level") or f.get("severity") or f.get("lvl")
    if "pri" in f:
        level: str | None = SYSLOG[int(f["pri"]) % 8]
    elif raw is not None and raw.isdigit():
        level = NUMERIC.get(int(raw) // 10 * 10)
    else:
        level = LEVELS.get(raw.lower()) if raw else None
    component = f.get("component") or f.get("name") or f.get("user")
    message = f.get("msg") or f.get("message") or ""
    if kind != "json" and len(lines) > 1:
        message = "\n".join([message, *lines[1:]])
    if kind == "csv":
        message = _cell(message)
    return _when(f), level, component, message


SCHEMA = "kind string, log_id string, first_line long, last_line long, ts timestamp, level string, component string, message string, layout string, raw string, early boolean, sync long, open_line long, quoted boolean"
_COLS = [c.split()[0] for c in SCHEMA.split(", ")]


def _odd(line: str) -> bool:
    return line.count('"') % 2 == 1


def _scan(prefixes: tuple[str, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted piece.

    Rows: whole records as ``entry``; the last record as ``open`` and lines before a log's first record as ``head``, with their
    text; of the first and the last log of the piece a ``piece`` row: sync is the line from which it does not matter whether
    the piece began inside a quoted cell (null: none), entries before are ``early``; open_line and quoted are the last
    record's; where there is no sync, quoted of the row ``inside`` says whether a cell open at the beginning is still open.
    """
    layouts = machine(prefixes)
    out: list[tuple] = []
    log, last_no = None, None
    start: tuple[str, dict[str, str]] | None = None
    first = begun = 0
    lines: list[str] = []
    quoted = False
    initial, inside, sync = True, True, None  # initial: in the first log of the piece; inside: the cell of another piece is open

    def close(final: bool) -> None:
        if not lines:
            return
        if start is None:
            out.append(("head", log, first, last_no, None, None, None, None, None, "\n".join(lines), False, None, None, None))
        elif final:
            out.append(("open", log, first, last_no, None, None, None, None, start[0], "\n".join(lines), False, None, None, None))
        else:
            ts, level, component, message = fields(*start, lines)
            out.append(("entry", log, first, last_no, ts, level, component, message, start[0], None, initial and (sync is None or first < sync), None, None, None))

    def piece(final: bool) -> None:
        if log is not None and (initial or final):
            at = first if final and start is not None else None
            out.append(("piece", log, begun, last_no, None, None, None, None, None, None, None, sync if initial else begun, at, final and quoted))
            if initial and sync is None:
                out.append(("inside", log, begun, last_no, None, None, None, None, None, None, None, None, None, inside))

    for pdf in batches:
        for lid, no, text in zip(pdf["log_id"], pdf["line_no"], pdf["line"]):
            if lid == log and no == last_no:
                continue
            text = text if isinstance(text, str) else ""
            at = begin(text, layouts)
            if lid != log:
                close(False)
                piece(False)
                initial = log is None
                log, start, first, begun, lines, quoted = lid, None, no, no, [], False
            if at is not None and quoted and at[0] != "csv":
                at = None
            if initial and sync is None:
                other = begin(text, layouts) if quoted else at
                if other is not None and (other[0] == "csv" or not inside):
                    sync = no
                elif inside and _odd(text):
                    inside = False
            if at is not None:
                close(False)
                start, first, lines = at, no, []
                quoted = at[0] == "csv" and _odd(text)
            elif quoted and _odd(text):
                quoted = False
            lines.append(text)
            last_no = no
        if len(out) >= 20_000:
            yield pd.DataFrame(out, columns=_COLS)
            out.clear()
    close(True)
    piece(True)
    yield pd.DataFrame(out, columns=_COLS)


EDGES = "log_id string, first_line long, last_line long, owner long, upto long, fetch boolean, dropped boolean"


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """What touches the edges of one log's pieces: rows of EDGES.

    The text rows (heads, open records) with the record they belong to, its last line, and whether its text must be read from the
    lines (because entries of a piece turned out to lie inside a quoted cell); rows ``dropped``: where such entries are.
    """
    inside = {r.first_line: bool(r.quoted) for r in pdf[pdf["kind"] == "inside"].itertuples()}
    heads = set(pdf.loc[pdf["kind"] == "head", "first_line"])
    out: list[tuple] = []
    owner, quoted, members, last, fetch = None, False, [], 0, False

    def done() -> None:
        out.extend((log, m, m, owner, last, fetch, False) for m in members)

    log = pdf["log_id"].iloc[0]
    for r in pdf[pdf["kind"] == "piece"].sort_values("first_line").itertuples():
        sync = None if pd.isna(r.sync) else int(r.sync)
        at = None if pd.isna(r.open_line) else int(r.open_line)
        if owner is not None and quoted:
            upto = int(r.last_line) if sync is None else sync - 1
            if upto >= r.first_line:
                last, fetch = upto, True
                out.append((log, int(r.first_line), upto, None, None, False, True))
            if sync is None:
                quoted = inside[r.first_line]
                continue
        elif r.first_line in heads:
            end = int(pdf.loc[(pdf["kind"] == "head") & (pdf["first_line"] == r.first_line), "last_line"].iloc[0])
            members.append(int(r.first_line))
            last = end
            if end == r.last_line:
                continue
        done()
        owner, members, quoted, fetch = at, [] if at is None else [at], bool(r.quoted), False
        last = int(r.last_line)
    done()
    return pd.DataFrame(out, columns=[c.split()[0] for c in EDGES.split(", ")]).astype({"owner": "Int64", "upto": "Int64"})


def _mend(prefixes: tuple[str, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    layouts = machine(prefixes)
    for pdf in batches:
        out = []
        for lid, a, b, raw in zip(pdf["log_id"], pdf["first_line"], pdf["last_line"], pdf["raw"]):
            lines = raw.split("\n")
            start = begin(lines[0], layouts)
            if start is not None:
                out.append((lid, a, b, *fields(*start, lines), start[0]))
        yield pd.DataFrame(out, columns=["log_id", "first_line", "last_line", "ts", "level", "component", "message", "layout"])


ENTRIES = "log_id string, first_line long, last_line long, ts timestamp, level string, component string, message string, layout string"


def entries(df: DataFrame, log: str = "log_id", number: str = "line_no", line: str = "line", prefixes: Iterable[str] = PREFIXES, unknown: bool = False) -> DataFrame:
    """Records of all logs: ``log_id, first_line, last_line, ts, level, component, message, layout``.

    prefixes: the settings of log_line_prefix to look for; unknown: also give the lines that belong to no record.
    """
    prefixes = tuple(prefixes)
    rows = df.select(F.col(log).cast("string").alias("log_id"), F.col(number).cast("long").alias("line_no"), F.regexp_replace(F.col(line), "[\r\n]", " ").alias("line"))
    rows = rows.where("log_id is not null and line_no is not null")
    pieces = cut(rows.repartitionByRange("log_id", "line_no").sortWithinPartitions("log_id", "line_no").mapInPandas(partial(_scan, prefixes), SCHEMA), name="logparse")
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    found = pieces.where("kind = 'entry'")
    # a few numbers a piece and log; the texts stay where they are
    edge = pieces.where("kind <> 'entry' and kind <> 'open'").select("kind", "log_id", "first_line", "last_line", "sync", "open_line", "quoted")
    edges = cut(edge.groupBy("log_id").applyInPandas(_resolve, EDGES), name="edges")
    if edges.where("dropped").limit(1).count():
        spoilt = edges.where("dropped").select(F.col("log_id").alias("_l"), F.col("first_line").alias("_a"), F.col("last_line").alias("_b"))  # at most a row a piece
        found = found.where("early").join(spoilt, (F.col("log_id") == F.col("_l")) & F.col("first_line").between(F.col("_a"), F.col("_b")), "left_anti").unionByName(found.where("not early"))
    texts = pieces.where("kind in ('open', 'head')").select("log_id", "first_line", "last_line", "raw", "kind")
    owned = edges.where("not dropped and owner is not null")
    joined = owned.where("not fetch").join(texts.drop("last_line"), ["log_id", "first_line"]).groupBy("log_id", "owner", "upto").agg(F.collect_list(F.struct("first_line", "raw")).alias("x"))
    if owned.where("fetch").limit(1).count():
        of = owned.where("fetch").select(F.col("log_id").alias("_l"), "owner", "upto").distinct()  # at most a row a piece
        read = rows.join(of, (F.col("log_id") == F.col("_l")) & F.col("line_no").between(F.col("owner"), F.col("upto")))
        read = read.groupBy("log_id", "owner", "upto", "line_no").agg(F.coalesce(F.first("line"), F.lit("")).alias("raw"))
        joined = joined.unionByName(read.groupBy("log_id", "owner", "upto").agg(F.collect_list(F.struct(F.col("line_no").alias("first_line"), "raw")).alias("x")))
    text = F.concat_ws("\n", F.transform(F.array_sort("x"), lambda x: x["raw"]))  # one record, which is one value of the result
    mended = joined.select("log_id", F.col("owner").alias("first_line"), F.col("upto").alias("last_line"), text.alias("raw")).mapInPandas(partial(_mend, prefixes), ENTRIES)
    out = found.select(*names).unionByName(mended)
    if unknown:
        kept = edges.where("dropped or owner is not null").select("log_id", "first_line").distinct()
        none = {c: F.lit(None).cast(dict(x.split() for x in ENTRIES.split(", "))[c]).alias(c) for c in names}
        lost = texts.where("kind = 'head'").join(kept, ["log_id", "first_line"], "left_anti")
        out = out.unionByName(lost.select("log_id", "first_line", "last_line", none["ts"], none["level"], none["component"], F.col("raw").alias("message"), none["layout"]))
    return out
