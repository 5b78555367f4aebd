"""The first rows of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Spark cuts groups inside each task, before the shuffle, up to this rank.
CUT_BEFORE_SHUFFLE = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], keep: int) -> DataFrame:
    """The first ``keep`` rows per group in ``order``, or of the whole table when ``by`` is empty.

    Whatever ``keep`` is, every task sends ``keep`` rows per group at most, so a hot group never meets whole.
    """
    if not by:
        return df.orderBy(*order).limit(keep)
    conf = df.sparkSession.conf
    conf.set(CUT_BEFORE_SHUFFLE, str(max(keep, int(conf.get(CUT_BEFORE_SHUFFLE)))))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= keep).drop("__rank")
