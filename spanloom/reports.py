"""Composite reports as DataFrames, and a text layer over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from spanloom.client import verify_anchors
from spanloom.functions.text import bar, pct, usd
from spanloom.operators import billing, fleet, grounding, lineage, measured
from spanloom.plans import rollup
from spanloom.plans.sqlplan import Shape, try_shape
from spanloom.session import cut


def shapes_of(spark: SparkSession, statements: list[tuple[int, str]], mode: str = "parity") -> tuple[list[tuple[int, Shape]], DataFrame]:
    """Shapes of one workload's statements (ids in the order of their start), and what was declined with the reason."""
    kept, declined = [], []
    for i, sql in statements:
        s, why = try_shape(spark, sql, mode)
        if s is None:
            declined.append((i, why))
        else:
            kept.append((i, s))
    return kept, spark.createDataFrame(declined, "shape_id long, reason string")


def anchors(spark: SparkSession, shapes: list[tuple[int, Shape]]) -> DataFrame:
    """The covering set: ``anchor_no, sql, synthetic, covers``."""
    chosen = rollup.cover(rollup.frame(spark, shapes)) if shapes else []
    return spark.createDataFrame([(n, s.sql(), syn, got) for n, (s, syn, got) in enumerate(chosen, 1)], "anchor_no int, sql string, synthetic boolean, covers array<long>")


def cover_summary(spark: SparkSession, shapes: list[tuple[int, Shape]], statements: int) -> DataFrame:
    """One row: modelled, excluded, anchors, covered and the share of distinct sub-plans (1 when nothing is covered)."""
    chosen = rollup.cover(rollup.frame(spark, shapes)) if shapes else []
    covered = sum(len(c) for _, _, c in chosen)
    return spark.createDataFrame([(len(shapes), statements - len(shapes), len(chosen), covered, len(chosen) / covered if covered else 1.0)], "modelled long, excluded long, anchors long, covered long, distinct_subplans double")


def trace_report(spark: SparkSession, spans: DataFrame, events: DataFrame, by: str = "trace_key") -> dict[str, DataFrame]:
    """Tree, redundancy, waste and bill of every trace."""
    joined = lineage.span_events(spans, events)
    costed = billing.attribute(joined, [by], "span_key").withColumn("parent_key", lineage.clean_id(F.col("parent_span_id")))
    return {"tree": lineage.plan_tree(spans), "redundancy": fleet.distinct_ratio(joined, ["exact", "ast"], by), "siblings": lineage.sibling_groups(costed),
            "waste": lineage.waste(costed, by), "bill": billing.bill(joined, [by], "span_key").withColumn("month_dollars", billing.extrapolate(F.col("dollars")))}


def compute_saved(anchor_ms: float, productive_s: float) -> float:
    """Part of the execution that rollups would have saved, 0 when they cost more."""
    return max(0.0, 1 - anchor_ms / (1000 * productive_s)) if productive_s > 0 else 0.0


ADVICE = "action string, subject string, dollars_now double, dollars_then double, gain double"


def recommendations(spark: SparkSession, bill: Row, waste: Row, cover: Row, anchor_ms: float, model: billing.Billing = billing.Billing()) -> DataFrame:
    """What one trace's numbers advise, as rows of ADVICE; nothing is rewritten or intercepted.

    bill, waste, cover: the trace's rows of :func:`trace_report` and :func:`cover_summary`; anchor_ms: what its rollups took to run.
    gain: a factor for batching, the share of execution saved for rollups, the share of the cost for unused results.
    """
    price = lambda seconds: seconds / 3600 * model.credits_per_hour * model.dollars_per_credit
    now, batched = price(bill["billed_s"]), price(bill["batched_s"])
    saved = compute_saved(anchor_ms, bill["productive_s"])
    return spark.createDataFrame([
        ("batch", f"{bill['spans']} statements in one warehouse window", now, batched, now / batched if batched else None),
        ("materialize", f"{cover['anchors']} rollups for {cover['covered']} of {cover['modelled']} aggregates", price(bill["productive_s"]), price(bill["productive_s"]) * (1 - saved), saved),
        ("drop", f"{waste['spans'] - waste['cited']} of {waste['spans']} results no answer used", waste["cost"], waste["cost"] - waste["wasted"], waste["wasted_share"]),
    ], ADVICE)


def single_trace(spark: SparkSession, spans: DataFrame, events: DataFrame, trace: str, mode: str = "parity", verify: int = 5) -> dict[str, DataFrame]:
    """The report of one trace (a workload of at most some thousand statements): tree, redundancy, cover, anchors run, waste, bill, advice."""
    mine = spans.where(lineage.clean_id(F.col("trace_id")) == trace)
    parts = {k: v.where(F.coalesce(*[F.col(c) for c in ("trace_key", "trace_id") if c in v.columns]) == trace) for k, v in trace_report(spark, mine, events).items()}
    rows = lineage.latest_spans(mine).orderBy("start_ms", "row_id").select("sql_text").collect()
    kept, _ = shapes_of(spark, [(i, r["sql_text"] or "") for i, r in enumerate(rows)], mode)
    parts["cover"], parts["anchors"] = cover_summary(spark, kept, len(rows)), anchors(spark, kept)
    parts["verified"] = verify_anchors(spark, [(str(r["anchor_no"]), r["sql"]) for r in parts["anchors"].orderBy("anchor_no").limit(verify).collect()], verify)
    ms = parts["verified"].where("error is null").agg(F.coalesce(F.sum("ms"), F.lit(0.0))).first()[0]
    parts["advice"] = recommendations(spark, parts["bill"].first(), parts["waste"].first(), parts["cover"].first(), ms)
    return parts


def sessions_per_anchor(chosen: list[tuple[Shape, bool, list[int]]], session_of: dict[int, str]) -> list[tuple[str, bool, int, int]]:
    """(statement, synthetic, statements covered, sessions they are from) of every anchor."""
    return [(s.sql(), synthetic, len(covers), len({session_of[i] for i in covers})) for s, synthetic, covers in chosen]


def anchor_sessions(statements: DataFrame, session: str) -> DataFrame:
    """Sessions per rollup over all statements of a table: ``anchor_no, sql, synthetic, statements, sessions``.

    statements: modelled shapes (``shape_id`` of each statement and the shape's columns) with their session.
    """
    fields = ["table", "measures", "groupby", "filters", "eq_cols"]
    folded = cut(rollup.distinct(statements), name="shapes")
    members = statements.select(F.col(session).alias("_s"), *fields).groupBy(*fields, "_s").agg(F.count(F.lit(1)).alias("_n"))
    of = members.join(folded.select("shape_id", *fields), fields).select("shape_id", "_s", "_n")
    got = rollup.cover_rows(folded).select("anchor_no", "sql", "synthetic", "shape_id").join(of, "shape_id")
    return got.groupBy("anchor_no", "sql", "synthetic").agg(F.sum("_n").alias("statements"), F.count_distinct("_s").alias("sessions"))


def lines(parts: dict[str, DataFrame], trace: str) -> list[str]:
    """The single-trace report as text."""
    one = lambda k: parts[k].first()
    red, waste, bill, cover = one("redundancy"), one("waste"), one("bill"), one("cover")
    used = {r["span_id"].lower(): r for r in parts["tree"].orderBy("position").collect()}
    out = [f"trace {trace}: {waste['spans']} statements", "", "plan tree"]
    out += [f"{'  ' * (r['depth'] + 1)}{r['span_id']}" for r in used.values()]
    out += ["", "redundancy", f"  distinct by text        {red['exact_distinct']} of {red['exact_total']}", f"  distinct by normal form {red['ast_distinct']} of {red['ast_total']}",
            f"  modelled                {cover['modelled']}, not modelled {cover['excluded']}", f"  rollups                 {cover['anchors']} answer {cover['covered']}",
            f"  distinct sub-plans      {pct(cover['distinct_subplans'])} {bar(cover['distinct_subplans'])}"]
    out += ["", "rollups run"] + [f"  {r['anchor']}: " + (f"{r['rows']} rows, {r['ms']:.0f} ms" if r["error"] is None else f"failed: {r['error']}") for r in parts["verified"].collect()]
    out += ["", "results no answer used", f"  {waste['spans'] - waste['cited']} of {waste['spans']}, {usd(waste['wasted'])} of {usd(waste['cost'])} ({pct(waste['wasted_share'])})"]
    out += ["", "bill", f"  resumes    {bill['windows']}", f"  billed     {bill['billed_s']:.1f} s, {usd(bill['dollars'])}", f"  productive {bill['productive_s']:.1f} s", f"  idle       {bill['overhead_s']:.1f} s ({pct(bill['idle_share'])})", f"  a month    {usd(bill['month_dollars'])}"]
    out += ["", "advice"] + [f"  {r['action']}: {r['subject']}, {usd(r['dollars_now'])} to {usd(r['dollars_then'])}" for r in parts["advice"].collect()]
    return out


def cross_session(spark: SparkSession, statements: DataFrame, mode: str = "parity") -> DataFrame:
    """One row: anchors per session added up against anchors of all sessions together.

    statements: ``session, at, sql`` of one experiment.
    """
    rows = statements.orderBy("at", "sql").collect()  # one experiment's statements, some hundreds
    shapes, _ = shapes_of(spark, [(i, r["sql"]) for i, r in enumerate(rows)], mode)
    own = {}
    for i, s in shapes:
        own.setdefault(rows[i]["session"], []).append((i, s))
    each = sum(len(rollup.cover(rollup.frame(spark, x))) for x in own.values())
    chosen = rollup.cover(rollup.frame(spark, shapes)) if shapes else []
    covered = sum(len(c) for _, _, c in chosen)
    shared = sum(n > 1 for *_, n in sessions_per_anchor(chosen, {i: r["session"] for i, r in enumerate(rows)}))
    n = len(shapes)
    return spark.createDataFrame([(len({r["session"] for r in rows}), len(rows), n, each, len(chosen), covered, shared, 1 - len(chosen) / each if each else 0.0, 1 - len(chosen) / max(covered, 1), 1 - len(chosen) / max(n, 1))],
                                 "sessions long, statements long, modelled long, session_anchors long, anchors long, covered long, shared_anchors long, redundancy double, dedup_covered double, dedup_modelled double")


def cross_session_lines(row: Row, bill: Row | None = None) -> list[str]:
    """:func:`cross_session` as text, with the bill of all sessions together if it is given."""
    out = [f"{row['sessions']} sessions, {row['statements']} statements, {row['modelled']} modelled", f"  rollups, each session for itself  {row['session_anchors']}",
           f"  rollups, all sessions together    {row['anchors']}, answering {row['covered']}; {row['shared_anchors']} serve several sessions",
           f"  redundancy across sessions        {pct(row['redundancy'])} {bar(row['redundancy'])}", f"  against answered statements       {pct(row['dedup_covered'])}", f"  against modelled statements       {pct(row['dedup_modelled'])}"]
    if bill is not None:
        out += [f"  billed {bill['billed_s']:.0f} s, {usd(bill['dollars'])}; productive {bill['productive_s']:.1f} s; idle {pct(bill['idle_share'])}", f"  per session {usd(bill['dollars'] / row['sessions'])}"]
    return out


def same_task_lines(ratios: DataFrame, verdict: str) -> list[str]:
    """:func:`same_task` as text."""
    return [f"  {r['kind']:<14} {r['size']} {r['distinct']:>6} of {r['total']:>6} {pct(r['ratio'])} {bar(r['ratio'])}" for r in ratios.orderBy("size", "kind").collect()] + [f"verdict: {verdict}"]


def same_task(spark: SparkSession, shapes: list[tuple[int, Shape]]) -> tuple[DataFrame, str]:
    """Sub-expression ratios of repeated attempts at one task, and the verdict."""
    r = rollup.subexpression_ratios(rollup.subexpressions(rollup.frame(spark, shapes)))
    whole = r.where("kind = 'all'").first()
    return r.orderBy("size", "kind"), fleet.verdict(whole["ratio"])


def measured_cost(history: DataFrame, attribution: DataFrame) -> DataFrame:
    return measured.summary(measured.per_trace(measured.tagged(history), attribution))


def score(events: DataFrame, answers: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """A run's result: statements, failures, claims and grounding, per ``by``."""
    runs = events.groupBy(*by).agg(F.count(F.lit(1)).alias("statements"), F.count("error").alias("failed"), F.count_distinct("result_hash").alias("distinct_results"))
    return runs.join(citations(events.where("result_values is not null"), answers, by, key).drop("events"), by, "left")


def citations(events: DataFrame, answers: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Claims and grounding side by side, per ``by``."""
    v = grounding.verify(events, answers, by, key)
    c = grounding.claims(events, answers, by).select(*key, "claimed").dropDuplicates(key)
    return grounding.totals(v.join(c, key, "left"), *by)
