"""Numbers that may be NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def known(value: Column) -> Column:
    """NaN becomes null. Spark orders NaN above every number, so a comparison with it would hold."""
    return F.when(~F.isnan(value), value)


def above(value: Column, bound: Column | float) -> Column:
    """``value > bound``, false for NaN, null for null."""
    return F.when(F.isnan(value), F.lit(False)).otherwise(value > bound)
