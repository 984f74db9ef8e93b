"""A deterministic agent workload over the demonstration warehouse: seven phases, 93 statements, four of them cited.

In one phase every statement is tried three times, each retry with the same meaning in other words.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from spanloom.sources.querylog import CHANNELS, REGIONS

SCHEMA = "seq int, label string, follows_from string, phase string, speculation_class string, span_intent string, sql string, attempt_n int, retry_of string, cited boolean"


def statements() -> list[tuple]:
    """Rows of SCHEMA in the order an agent that hunts for a revenue drop would issue them."""
    out: list[tuple] = []

    def add(phase: str, intent: str, sql: str, follows: str | None = None, kind: str | None = None, cited: bool = False, attempt: int = 1, retry_of: str | None = None) -> str:
        label = f"q{len(out) + 1}"
        out.append((len(out) + 1, label, follows, phase, kind or ("refine" if follows else "probe"), intent, sql, attempt, retry_of, cited))
        return label

    first = add("overview", "orders by month", "select date_trunc('month', order_date) as month, count(*), sum(amount) from orders group by 1", cited=True)
    for r in REGIONS:  # 3
        add("regions", f"revenue of {r}", f"select sum(amount), count(*) from orders where region = '{r}'", first)
    cells = [add("cells", f"revenue of {r} by {c}", f"select sum(amount) from orders where region = '{r}' and channel = '{c}'", first) for r in REGIONS for c in CHANNELS]  # 12
    days = [date(2026, 7, 1) + timedelta(n) for n in range(31)]
    daily = [add("days", f"revenue on {x}", f"select sum(amount), count(*) from orders where order_date = '{x}'", cells[4], cited=x == date(2026, 7, 12)) for x in days]  # 31
    hot = [add("days", f"EMEA paid_search on {x}", f"select sum(amount) from orders where order_date = '{x}' and region = 'EMEA' and channel = 'paid_search'", daily[11], cited=x == date(2026, 7, 12)) for x in days]  # 31
    for c in CHANNELS:  # 12
        last = None
        for n, sql in enumerate((f"select avg(amount) from orders where channel = '{c}' and region = 'EMEA'", f"SELECT  avg(amount)\nFROM orders o\nWHERE o.region = 'EMEA' AND o.channel = '{c}'",
                                 f"select avg(amount) from orders as t where t.channel = '{c}' and t.region = 'EMEA';"), 1):
            last = add("amounts", f"average amount of {c}", sql, hot[11], attempt=n, retry_of=last)
    dead = add("refunds", "refunds by month", "select date_trunc('month', refund_date) as month, count(*) from refunds group by 1", first)
    add("refunds", "refunds by day", "select refund_date, sum(amount) from refunds group by refund_date order by refund_date", dead)
    add("final", "EMEA paid_search by day", "select order_date, sum(amount), avg(amount) from orders where region = 'EMEA' and channel = 'paid_search' group by order_date order by order_date", hot[11], "final", True)
    return out


def workload(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(statements(), SCHEMA)
