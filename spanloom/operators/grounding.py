"""Which results reached an answer: values of result sets against the numbers and words of the text.

Defined results: a value repeated in one result set counts once; an event without values is not grounded; a null answer
grounds nothing; where there are several answers, each is searched, and a value in any of them is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T


def values_of(events: DataFrame, key: list[str], values: str = "result_values") -> DataFrame:
    """One row a value of an event, in order; ``norm`` is the value as it is compared."""
    v = events.select(*key, F.posexplode(values).alias("pos", "value")).where("value is not null")
    number = T.as_number(F.col("value"))
    return v.withColumn("number", number).withColumn("norm", F.when(number.isNotNull(), F.concat(F.lit("n:"), number.cast("string"))).otherwise(F.concat(F.lit("s:"), F.col("value"))))


def value_frequency(events: DataFrame, by: list[str], key: list[str], values: str = "result_values") -> DataFrame:
    """In how many result sets of ``by`` each value occurs."""
    v = values_of(events, [*by, *[k for k in key if k not in by]], values)
    return v.select(*by, *[k for k in key if k not in by], "norm").distinct().groupBy(*by, "norm").agg(F.count(F.lit(1)).alias("sets"))


def verify(events: DataFrame, answers: DataFrame, by: list[str], key: list[str], values: str = "result_values", text: str = "text") -> DataFrame:
    """``key, grounded, uniquely_grounded, evidence`` (first four values found) of every event with an answer.

    answers holds any number of texts per ``by``. Numbers of a text are extracted once; a value meets every answer of its own ``by``.
    """
    a = answers.select(*by, F.lower(text).alias("_lower"), T.numbers(F.col(text)).alias("_numbers"))
    v = values_of(events, [*by, *[k for k in key if k not in by]], values)
    freq = value_frequency(events, by, key, values)
    hit = F.when(F.col("number").isNotNull(), T.number_present(F.col("number"), F.col("_numbers"))).otherwise(T.text_present(F.col("value"), F.col("_lower")))
    # a value meets the texts of its trace and leaves them behind: only values that are found go on
    found = v.join(a, by).where(F.coalesce(hit, F.lit(False))).select(*[c for c in v.columns if c != "number"]).distinct().join(freq, [*by, "norm"])
    agg = found.groupBy(*key).agg(
        F.lit(True).alias("grounded"), F.bool_or(F.col("sets") == 1).alias("uniquely_grounded"),
        F.transform(F.slice(F.array_sort(F.collect_set(F.struct("pos", "value"))), 1, 4), lambda x: x["value"]).alias("evidence"))
    empty = F.array().cast("array<string>")
    return events.join(a.select(*by).distinct(), by, "left_semi").select(*key).distinct().join(agg, key, "left").select(
        *key, F.coalesce("grounded", F.lit(False)).alias("grounded"), F.coalesce("uniquely_grounded", F.lit(False)).alias("uniquely_grounded"), F.coalesce("evidence", empty).alias("evidence"))


def claims(events: DataFrame, answers: DataFrame, by: list[str], label: str = "label", text: str = "text") -> DataFrame:
    """Events with ``claimed``: whether the CITED line of any of their answers names their label; null without such a line."""
    a = answers.select(*by, T.cited(F.col(text)).alias("_c")).groupBy(*by).agg(F.collect_set("_c").alias("_c"))
    a = a.select(*by, F.when(F.size("_c") > 0, F.array_distinct(F.flatten("_c"))).alias("_cited"))
    return events.join(a, by, "left").withColumn("claimed", F.when(F.col("_cited").isNotNull(), F.array_contains("_cited", F.lower(F.col(label))))).drop("_cited")


def totals(verified: DataFrame, *by: str) -> DataFrame:
    """Events, claimed, grounded, unique, and the two kinds of disagreement."""
    c = F.coalesce("claimed", F.lit(False))
    return verified.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), F.count_if(c).alias("claimed"), F.count_if("grounded").alias("grounded"), F.count_if("uniquely_grounded").alias("unique"),
                                     F.count_if(c & ~F.col("grounded")).alias("claimed_ungrounded"), F.count_if(~c & F.col("grounded")).alias("grounded_unclaimed"))
