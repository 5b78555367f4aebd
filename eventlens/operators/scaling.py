"""Null filling and standardising of feature columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from eventlens.functions.numbers import known
from eventlens.operators.joins import join_null_safe


def fill_with_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and NaN become 0."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})


def fill_with_mean(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Null and NaN become the column's mean over the table (or over its group); all-null columns stay null."""
    clean = {c: F.when(~F.isnan(F.col(c)), F.col(c).cast("double")) for c in columns}
    df = df.withColumns(clean)
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"__mean_{c}") for c in columns])
    if by:
        joined = join_null_safe(df, means, by, "left")
        return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__mean_{c}")) for c in columns}).drop(
            *[f"__mean_{c}" for c in columns]
        )
    one = means.select(F.struct(*means.columns).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), one[f"__mean_{c}"]) for c in columns})


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature, fitted once."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> "Scaler":
        """One aggregation over the known values; two numbers per feature come to the driver."""
        row = df.agg(
            *[F.avg(known(F.col(c))).alias(f"mean_{i}") for i, c in enumerate(features)],
            *[F.stddev_pop(known(F.col(c))).alias(f"std_{i}") for i, c in enumerate(features)],
        ).first()
        k = len(features)
        return cls(tuple(features), tuple(row[:k]), tuple(row[k:]))

    def transform(self, df: DataFrame) -> DataFrame:
        """(x - mean) / std; a constant column is only shifted."""
        return df.withColumns(
            {
                c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)
                for c, m, s in zip(self.features, self.means, self.stds, strict=True)
            }
        )


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fit and transform in one lazy query: the statistics, over the known values, are a scalar subquery. NaN stays NaN."""
    stats = df.agg(
        *[F.avg(known(F.col(c))).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(known(F.col(c))).alias(f"std_{c}") for c in columns],
    )
    one = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.withColumns(
        {
            c: (F.col(c) - one[f"mean_{c}"])
            / F.when(one[f"std_{c}"] == 0, F.lit(1.0)).otherwise(one[f"std_{c}"])
            for c in columns
        }
    )
