"""Exact dedup: frequent digests are settled by a broadcast, all others by a shuffle.

A Misra-Gries summary (Spark's own ``freqItems``) names every digest that may fill a share ``support``
of the rows, at most ``1 / support`` of them. One pass counts just those exactly. The verified ones are
broadcast with their winner, and their rows never reach a shuffle, so no task gets a hot group. Every
other digest is below the share and goes through an ordinary window over its digest.

Cases: a null text counts as empty, so nulls and empty texts are one group. Of equal texts the row with
the largest id stays; rows that share this id are one document and all carry ``kept``. If every id of a
group is null, ``keep_id`` is null and all of them stay. An empty table gives an empty result. Only the
id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventlens.session import settle

SUPPORT = 0.001


def normalised(text: Column) -> Column:
    """A-Z lowered, nothing else. ``lower`` does just that where every character is one byte."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = settle(
        docs.select(
            F.col(f"`{id_column}`").alias("doc_id"),
            F.sha2(F.encode(normalised(F.col(f"`{text_column}`")), "UTF-8"), 256).alias("text_sha256"),
        )
    )
    winners = frequent(digests, support)
    marked = digests.join(F.broadcast(winners), "text_sha256", "left")
    hot = marked.where(F.col("group_size").isNotNull())
    group = W.partitionBy("text_sha256")
    rest = marked.where(F.col("group_size").isNull()).select(
        "text_sha256", "doc_id", F.max("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    return hot.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def frequent(digests: DataFrame, support: float) -> DataFrame:
    """text_sha256, keep_id, group_size of the digests that hold a share ``support`` of the rows; at most 1 / support rows."""
    named = digests.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    counted = (
        digests.join(F.broadcast(named), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return counted.where(F.col("group_size") >= F.lit(max(2.0, support * digests.count())))


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = exact_groups(docs, id_column, text_column, support)
    stay = groups.where("kept").select(F.col("doc_id").alias("__stays"), F.col("text_sha256").alias("__sha")).distinct()
    # By text as well: an id may have several, of which one stays.
    sha = F.sha2(F.encode(normalised(docs[f"`{text_column}`"]), "UTF-8"), 256)
    return docs.join(stay.hint("merge"), docs[f"`{id_column}`"].eqNullSafe(stay["__stays"]) & (sha == stay["__sha"]), "left_semi")
