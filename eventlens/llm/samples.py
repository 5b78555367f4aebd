"""Bounded samples of labelled texts for fitting models: some chunks of some rows per label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from eventlens.llm.texts import slices

CHUNK = 512
# Chunks taken from one text, evenly over the whole of it.
PER_TEXT = 4


def held_out(doc_id, divisor: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def labelled_chunks(texts: DataFrame, labels: DataFrame, per_label: int) -> dict[object, list[bytes]]:
    """Chunks of the texts of at most ``per_label`` rows per label, the first by a hash of their id.

    ``texts`` has doc_id and text, ``labels`` doc_id and label. At most ``PER_TEXT * per_label`` chunks of
    ``CHUNK`` bytes per label come to the driver, however large the tables are; chosen ids are broadcast.
    There are as many labels as the caller lets through.
    """
    order = W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    marked = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    # A bound on the hash lets a few times as many ids through as are wanted, so a frequent label's rows never meet.
    bound = F.lit(2**63 - 1)
    for row in marked.groupBy("label").count().collect():
        share = (4 * per_label + 100) / row["count"]
        if share < 1:
            bound = F.when(F.col("label") == F.lit(row.label), F.lit(int(-(2**63) + share * 2**64))).otherwise(bound)
    chosen = (
        marked.where(F.xxhash64("doc_id") <= bound)
        .distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= per_label)
        .select("doc_id", "label")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, offsets in slices(batches):
            source, chunks = [], []
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                starts = sorted(set(np.linspace(a, max(a, b - CHUNK), PER_TEXT).astype(int).tolist())) if b - a > CHUNK else [a]
                source += [row] * len(starts)
                chunks += [flat[s : min(b, s + CHUNK)].tobytes() for s in starts]
            yield pa.RecordBatch.from_arrays([rows.column("label").take(pa.array(source, pa.int64())), pa.array(chunks, pa.binary())], names=["label", "chunk"])

    kind = labels.schema["label"].dataType.simpleString()
    found = texts.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(cut, f"label {kind}, chunk binary")
    bounded = W.partitionBy("label").orderBy(F.xxhash64("chunk"), "chunk")
    kept = found.withColumn("rank", F.row_number().over(bounded)).where(F.col("rank") <= PER_TEXT * per_label)
    out: dict[object, list[bytes]] = {}
    for row in kept.select("label", "chunk").orderBy("label", F.xxhash64("chunk"), "chunk").collect():
        out.setdefault(row.label, []).append(bytes(row.chunk))
    return out
