"""Texts inside tasks: bounded slices of Arrow batches, and texts cut into pieces that repeat often."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

# Bytes of text that one step of a task handles at once; a longer text is a slice of its own.
SLICE_BYTES = 16 << 20

# A cut says, for all bytes of a slice, where a new piece starts.
Cut = Callable[[np.ndarray], np.ndarray]


# Bytes of an Arrow batch, but for a single row that is longer.
BATCH_BYTES = 32 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long texts has to fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``, after which the worker gives back the memory that it no longer uses; Spark keeps workers for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    # Only glibc has it; elsewhere freed memory goes back by itself or stays.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets) with about ``size`` bytes of text each; a null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        start, ends = 0, text_offsets(texts)
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, side="right")) - 1)
            own = texts.slice(start, stop - start)
            offsets = text_offsets(own)
            data = own.buffers()[2]
            flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
            yield batch.slice(start, stop - start), flat, offsets - offsets[0]
            start = stop


def text_offsets(texts: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]


def distinct_pieces(flat: np.ndarray, offsets: np.ndarray, cut: Cut) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different pieces of a slice, the piece at every place, and the first place of every row (and the end).

    Pieces never cross rows and together hold every byte.
    """
    if not len(flat):
        return [], np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    starts = cut(flat)
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    places = np.flatnonzero(starts)
    ends = np.append(places, len(flat)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
    coded = pieces.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(places, offsets)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_SIGN = np.arange(256) < 128
_SIGN &= ~_LETTER
_SIGN[[ord(" "), ord("\n")]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lowered(flat: np.ndarray) -> np.ndarray:
    """A-Z lowered."""
    return _LOWER[flat]


def word_starts(flat: np.ndarray) -> np.ndarray:
    """Pieces end behind a blank or line end, and between an ASCII letter and an ASCII sign."""
    starts = np.empty(len(flat), bool)
    starts[0] = True
    starts[1:] = (flat[:-1] == 0x20) | (flat[:-1] == 0x0A) | (_LETTER[flat[:-1]] & _SIGN[flat[1:]])
    return starts


def after_blank(flat: np.ndarray) -> np.ndarray:
    """Pieces end behind a blank or line end only."""
    starts = np.empty(len(flat), bool)
    starts[0] = True
    starts[1:] = (flat[:-1] == 0x20) | (flat[:-1] == 0x0A)
    return starts


def plain_word(piece: str) -> str | None:
    """The word in lower case if the piece is Latin letters (and a blank) only: no rule splits or rewrites it further."""
    word = piece.strip(" \n").lower()
    return word if word.isalpha() and max(word) < "\u0250" else None


def spread(lengths: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Indices first, first + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(firsts - starts, lengths)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between neighbouring bounds, along the first axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.result_type(values, np.int64) if values.dtype.kind in "iub" else values.dtype)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
