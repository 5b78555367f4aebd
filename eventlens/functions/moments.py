"""Summaries of numbers that can be merged: count, missing, mean, sum of squared deviations, least, greatest.

A summary is a struct. Two are merged by the pairwise formula (Chan, Golub, LeVeque), which keeps the digits
that sums of squares lose, so the summary of a table is the same however it was cut into parts.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eventlens.functions.numbers import known

TYPE = "struct<n: bigint, missing: bigint, mean: double, m2: double, lo: double, hi: double>"


def moments(value: Column) -> Column:
    """Aggregate: the summary of a column. Null and NaN are missing."""
    number = known(value.cast("double"))
    return F.struct(
        F.count(number).alias("n"),
        (F.count(F.lit(1)) - F.count(number)).alias("missing"),
        F.avg(number).alias("mean"),
        (F.var_pop(number) * F.count(number)).alias("m2"),
        F.min(number).alias("lo"),
        F.max(number).alias("hi"),
    ).cast(TYPE)


def nothing() -> Column:
    """The summary of no rows."""
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    return F.struct(zero.alias("n"), zero.alias("missing"), none.alias("mean"), none.alias("m2"), none.alias("lo"), none.alias("hi")).cast(TYPE)


def merged(a: Column, b: Column) -> Column:
    """The summary of the rows of two summaries."""
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    mean = a["mean"] + apart * b["n"] / n
    m2 = a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n
    one = F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"])
    return F.struct(
        n.alias("n"),
        (a["missing"] + b["missing"]).alias("missing"),
        F.coalesce(one, F.when(n > 0, mean)).alias("mean"),
        F.when(a["n"] == 0, b["m2"]).when(b["n"] == 0, a["m2"]).otherwise(m2).alias("m2"),
        F.least(a["lo"], b["lo"]).alias("lo"),
        F.greatest(a["hi"], b["hi"]).alias("hi"),
    ).cast(TYPE)


def merged_all(summaries: Column) -> Column:
    """The summary of an array of summaries."""
    return F.aggregate(summaries, nothing(), merged)


def deviation(summary: Column, sample: bool = False) -> Column:
    """Population or sample deviation; null without enough rows."""
    n = summary["n"] - 1 if sample else summary["n"]
    return F.sqrt(F.try_divide(summary["m2"], F.when(n > 0, n)))
