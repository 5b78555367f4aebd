"""Shannon entropy as aggregates over (count, how many values have that count) rows.

Grouping a frequency table by its counts leaves at most sqrt(2N) rows for N events, however
many distinct values there are, so these sums never meet an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SMOOTHING = 1e-10


def entropy_basic(n: Column, values: Column) -> Column:
    """Bits: log2(N) - sum(values * n * log2 n) / N; 0 when there is no row."""
    total = F.sum(n * values)
    return F.coalesce(F.log2(total) - F.try_divide(F.sum(values * n * F.log2(n)), total), F.lit(0.0))


def sizes_total(sizes: Column) -> Column:
    """Rows behind an array of (n, m): m values that occur n times each."""
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda total, x: total + x["n"] * x["m"])


def entropy_of_sizes(sizes: Column, total: Column, smoothing: float = 0.0) -> Column:
    """Bits from an array of (n, m) and its total, with ``smoothing`` added inside the logarithm; 0 without rows."""

    def add(bits: Column, x: Column) -> Column:
        p = x["n"] / total
        return bits - x["m"] * p * F.log2(p + F.lit(smoothing))

    return F.aggregate(sizes, F.lit(0.0), add)


def entropy_smoothed(n: Column, values: Column, total: Column) -> Column:
    """Bits with 1e-10 added inside the logarithm; ``total`` is N on every row."""
    p = n / total
    return F.coalesce(F.lit(0.0) - F.sum(values * p * F.log2(p + F.lit(SMOOTHING))), F.lit(0.0))
