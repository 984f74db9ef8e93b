"""Running statements as traced spans: guard, tag, execute, capture, event."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.context import Span, Trace
from spanloom.functions.fingerprint import unordered_hash
from spanloom.plans.dialect import translate
from spanloom.plans.sqlplan import refusal
from spanloom.session import cut, release
from spanloom.sources.querylog import EVENTS

#: Rows looked at, longest string kept, values after which capture stops, rows of a preview.
CAPTURE_ROWS, CAPTURE_CHARS, CAPTURE_VALUES, PREVIEW_ROWS = 200, 64, 400, 50


def scalar_values(rows: list[dict]) -> list[str]:
    """Distinct scalar values of the first rows, as text: nulls and long strings left out, days in ISO form.

    Capture ends with the row in which the number of values passes the limit.
    """
    out: dict[str, None] = {}
    for row in rows[:CAPTURE_ROWS]:
        for v in row.values():
            if v is None or isinstance(v, (list, dict, bytes, tuple)):
                continue
            if isinstance(v, (datetime, date)):
                t = v.isoformat()[:10]
            elif isinstance(v, bool):
                t = str(v).lower()
            elif isinstance(v, Decimal):
                t = str(float(v))
            else:
                t = str(v)
            if isinstance(v, str) and len(t) > CAPTURE_CHARS:
                continue
            out.setdefault(t)
        if len(out) > CAPTURE_VALUES:
            break
    return list(out)


def whole_result(df: DataFrame) -> tuple[list[dict], int, str]:
    """The first rows of a result in its order, and the number and hash of all its rows (whatever their order).

    The statement runs once: its result is written to the shared folder with the place of every row.
    """
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    flat = flat.select(*[F.col(c).cast("string") if kind == "void" else F.col(c) for c, kind in flat.dtypes], F.monotonically_increasing_id().alias("_at"))
    kept = cut(flat, name="result")
    try:
        named = F.struct(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
        n, digest = kept.agg(F.count(F.lit(1)), unordered_hash(named)).first()
        first = kept.orderBy("_at").limit(max(CAPTURE_ROWS, PREVIEW_ROWS)).drop("_at").collect()
        return [dict(zip(names, r.asDict(recursive=True).values())) for r in first], n, digest
    finally:
        release(kept)


class TracedSession:
    """One agent's task: every statement becomes a span with an event."""

    def __init__(self, spark: SparkSession, agent_id: str, model_id: str | None = None, timeout_s: float | None = 120.0, dialect: bool = True, mode: str = "observe") -> None:
        """dialect: statements are written for the warehouse (:mod:`spanloom.plans.dialect`), not for Spark. mode: only ``observe``; nothing is intercepted."""
        if mode != "observe":
            raise NotImplementedError(f"mode {mode}: statements are observed, never rewritten or answered from elsewhere")
        self.spark, self.timeout_s, self.dialect = spark, timeout_s, dialect
        self.trace = Trace(agent_id, model_id)
        self.events: list[dict] = []
        self._by_label: dict[str, str] = {}
        self._lock = threading.Lock()

    def run(self, sql: str, intent: str, follows_from: str | None = None, question: str | None = None, retry_of: dict | None = None) -> dict:
        """Guard, run and record; returns the event with ``preview`` (rows, at most 50).

        rows and result_hash are of the whole result; values are those of its first rows. retry_of: the event of the attempt
        this one repeats.
        """
        with self._lock:
            label = f"q{len(self.events) + 1}"
            span = Span(self.trace, intent, "refine" if follows_from else "probe", self._by_label.get(follows_from or ""))
            event = {"trace_id": self.trace.trace_id, "span_id": span.span_id, "parent_span_id": span.parent_span_id, "label": label, "speculation_class": span.speculation_class,
                     "span_intent": intent, "attempt_n": 1, "retry_of": None, "question": question, "error": None, "used_downstream": None}
            if retry_of:
                event |= {k: retry_of[k] for k in ("parent_span_id", "speculation_class", "span_intent")} | {"attempt_n": retry_of["attempt_n"] + 1, "retry_of": retry_of["span_id"]}
            self.events.append(event)
            self._by_label[label] = span.span_id
        began, rows, n, digest = time.time(), [], 0, None
        text = sql.strip().rstrip(";")
        why = None
        try:
            text = translate(self.spark, text) if self.dialect else text
        except Exception as e:
            why = f"not understood: {e}"
        why = why or refusal(self.spark, text)
        if why:
            event["error"] = why
        else:
            timer = threading.Timer(self.timeout_s, self.spark.interruptTag, [span.span_id]) if self.timeout_s else None
            self.spark.addTag(span.span_id)
            try:
                if timer:
                    timer.start()
                rows, n, digest = whole_result(self.spark.sql(text))
            except Exception as e:
                event["error"] = str(e).strip().split("\n")[0][:300]
            finally:
                if timer:
                    timer.cancel()
                self.spark.removeTag(span.span_id)
        event |= {"client_ms": round(1000 * (time.time() - began), 2), "rows": n, "result_hash": digest, "values": scalar_values(rows), "query_id": span.span_id if not event["error"] else None}
        return event | {"preview": rows[:PREVIEW_ROWS]}

    def run_until(self, attempts: Iterable[str], intent: str, follows_from: str | None = None) -> dict:
        """Run a statement, and while it fails its next rewriting as a retry of the last attempt; the event of the last one."""
        event: dict | None = None
        for sql in attempts:
            event = self.run(sql, intent, follows_from, retry_of=event)
            if not event["error"]:
                break
        if event is None:
            raise ValueError("no statement")
        return event

    def cite(self, labels: Iterable[str]) -> None:
        """Declare which results the answer used."""
        used = {x.lower() for x in labels}
        for e in self.events:
            e["used_downstream"] = e["label"] in used

    def to_df(self) -> DataFrame:
        names = [c.strip().split(" ")[0] for c in EVENTS.split(", ")]
        return self.spark.createDataFrame([tuple(e.get(n) for n in names) for e in self.events], EVENTS)


def pool(spark: SparkSession, work: list[Callable[[], object]], at_once: int = 4) -> list[object]:
    """Run callables with bounded concurrency, in order of submission; a failure is returned as its exception."""
    def one(f: Callable[[], object]) -> object:
        try:
            return f()
        except Exception as e:
            return e
    with ThreadPoolExecutor(at_once) as ex:
        return list(ex.map(one, work))


def verify_anchors(spark: SparkSession, anchors: list[tuple[str, str]], first: int = 5) -> DataFrame:
    """Run the first anchors' statements: rows, milliseconds, error."""
    out = []
    for name, sql in anchors[:first]:
        began = time.time()
        try:
            n, error = spark.sql(sql).count(), None
        except Exception as e:
            n, error = None, str(e).split("\n")[0][:200]
        out.append((name, n, round(1000 * (time.time() - began), 1), error))
    return spark.createDataFrame(out, "anchor string, rows long, ms double, error string")
