"""Numbers that stand for rows where ids are missing or repeat with different texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventlens.session import settle


def keyed(rows: DataFrame, nulls_first: bool) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (doc_id long, text string, others) with ``id``, which is never null, ascends with doc_id, and belongs to one text.

    Where all ids are there and repeat, if at all, with the same text, it is the id itself: a count by id that moves
    hashes finds that out. Else the different pairs of id and text are numbered in their order, through one
    range shuffle of ids and digests, and the second result says which id a number stands for. Null and empty texts are equal.
    """
    text = F.coalesce("text", F.lit(""))
    hashed = F.xxhash64(text)
    odd = rows.groupBy("doc_id").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high")).where("doc_id is null or low <> high")
    if odd.isEmpty():
        return rows.withColumn("id", F.col("doc_id")), None
    digest = F.sha2(text.cast("binary"), 256)
    order = F.col("doc_id").asc_nulls_first() if nulls_first else F.col("doc_id").asc_nulls_last()
    pairs = rows.select("doc_id", digest.alias("digest")).distinct()
    sorted_ = pairs.repartitionByRange(order, "digest").sortWithinPartitions(order, "digest")
    numbers = settle(sorted_.withColumn("id", F.monotonically_increasing_id()))
    named = numbers.select(F.col("doc_id").alias("numbered_id"), F.col("digest").alias("numbered_digest"), "id")
    same = F.col("doc_id").eqNullSafe(F.col("numbered_id")) & (digest == F.col("numbered_digest"))
    return settle(rows.join(named, same).drop("numbered_id", "numbered_digest")), numbers.select("id", "doc_id")
