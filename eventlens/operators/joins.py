"""Joins whose keys may be null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a null key equals a null key; the keys come from the left side.

    Left open to Spark: a small right side is broadcast after its size is known, and AQE splits the
    partitions of a hot key.
    """
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__{k}" for k in keys])
