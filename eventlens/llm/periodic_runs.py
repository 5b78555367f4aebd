"""Runs of words that repeat with a period, found by minimizers at several scales, and texts without the repeats.

A run is a longest stretch of words with smallest period q that holds ``TURNS`` periods and ``LEAST`` words at
least. A match at distance d is a place whose word is the word d places on; a run with period q is a stretch
of matches at distance q, q words shorter than the run.

* Periods up to ``DIRECT`` are scanned directly: one comparison of the words with themselves per distance.
* Longer periods come from scales [b, 1.5 b). With k = 1.5 b, k-grams are named by hashes, and every window of k
  k-grams keeps its least names. A run with a period q of the scale holds windows that cover a whole period;
  as k >= q, the rotations of its period differ, so each window's least name stands at one place per period,
  and two neighbouring kept places with equal names lie q apart. Each such pair is extended to both sides,
  word by word. 2 k = 3 b <= 3 q words of window and gram leave q of the run's 4 q words to start windows at, so
  no run is missed (but for equal 64-bit names of different k-grams; a wrong pair is never taken, as it is
  compared).

A scale costs a few passes over the words of the texts that are long enough for it, and there are as many
scales as the logarithm of the longest text. No rows are shuffled; a task holds one slice of texts, or one text.

Cases: a null text has no words; nor has one of white space only. A text of any length is one row. Runs may
overlap. Ties for the longest run go to the smallest start, then the smallest period. Rows that repeat, or
have no id, are treated one by one. An empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.texts import prepare, slices, spread

TURNS, LEAST = 4, 6
# Largest period that is found by direct comparison.
DIRECT = 64
# Bytes of text handled at once; the arrays of a slice take some forty times as much.
SLICE = 4 << 20

Run = tuple[int, int, int]
# Changes the words of a text, given its id: places in the text, in their new order.
Reorder = Callable[[object, int], np.ndarray | None]

SCHEMA = (
    "doc_id {id}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def split_words(flat: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The different words of a slice, the word at every place, and the first place of every text (and the end)."""
    blank = (flat == 0x20) | ((flat >= 0x09) & (flat <= 0x0D))
    begins = ~blank
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    begins[1:] &= blank[:-1] | edge[1:-1]
    places = np.flatnonzero(begins)
    solid = np.cumsum(~blank)
    ends = np.append(solid[places] - 1, solid[-1] if len(flat) else 0).astype(np.int64)
    letters = np.ascontiguousarray(flat[~blank])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(places, offsets)


def find_runs(words: np.ndarray, bounds: np.ndarray, direct: int = DIRECT) -> list[list[Run]]:
    """The runs (start, length, period) of every text, by start and period; ``bounds`` are the texts' first places and the end."""
    sizes = np.diff(bounds)
    # Numbered by text, words of different texts differ, and so no match or gram crosses a border.
    own = words + np.repeat(np.arange(len(sizes), dtype=np.int64) << 32, sizes)
    found: set[Run] = set()
    longest = int(sizes.max(initial=0))
    for period in range(1, min(direct, longest // TURNS) + 1):
        found.update(_direct(own, period))
    low = direct + 1
    while low * TURNS <= longest:
        high = low + (low + 1) // 2
        wide = np.flatnonzero(sizes >= low * TURNS)
        places = spread(sizes[wide], bounds[:-1][wide])
        inside = own if len(wide) == len(sizes) else own[places]
        found.update((int(places[s]), n, q) for s, n, q in _at_scale(inside, low, high))
        low = high
    out: list[list[Run]] = [[] for _ in sizes]
    texts = np.searchsorted(bounds, [r[0] for r in found], side="right") - 1
    for (start, length, period), text in zip(found, texts.tolist(), strict=True):
        out[text].append((start - int(bounds[text]), length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def least_length(period: int) -> int:
    return max(LEAST, TURNS * period)


def _direct(words: np.ndarray, period: int) -> Iterator[Run]:
    """Runs with this period: stretches of matches at its distance."""
    if len(words) <= period:
        return
    places = np.flatnonzero(words[:-period] == words[period:])
    breaks = np.flatnonzero(np.diff(places) != 1) + 1
    firsts, lasts = np.append(0, breaks), np.append(breaks, len(places)) - 1
    long = np.flatnonzero(lasts - firsts + 1 >= least_length(period) - period) if len(places) else []
    for i in long:
        start, end = int(places[firsts[i]]), int(places[lasts[i]]) + 1 + period
        if _primitive(words, start, period):
            yield start, end - start, period


def _primitive(words: np.ndarray, start: int, period: int) -> bool:
    """Whether the run has no smaller period; one would divide this period, as the run is four times as long."""
    turn = words[start : start + period]
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            if np.array_equal(turn, np.roll(turn, period // factor)):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _at_scale(words: np.ndarray, low: int, high: int) -> Iterator[Run]:
    """Runs with periods from ``low`` to below ``high``, at most 1.5 times as much."""
    names = _gram_names(words, high)
    kept = _minimizers(names, high)
    order = np.argsort(names[kept], kind="stable")
    values, places = names[kept][order], kept[order]
    apart = np.diff(places)
    paired = (values[1:] == values[:-1]) & (apart >= low) & (apart < high)
    seeds = sorted(zip(apart[paired].tolist(), places[:-1][paired].tolist(), strict=True))
    reached = (0, 0)
    for period, place in seeds:
        # Seeds of one period come in their order; one that lies in the stretch found before is part of it.
        if reached[0] == period and place < reached[1]:
            continue
        start, end = _stretch(words, place, period)
        reached = (period, end)
        if end - start + period >= least_length(period) and _primitive(words, start, period):
            yield start, end - start + period, period


def _stretch(words: np.ndarray, place: int, period: int) -> tuple[int, int]:
    """First place and end of the matches at distance ``period`` around ``place``, compared in steps that double."""
    end, step = place, 64
    while end < len(words) - period:
        stop = min(end + step, len(words) - period)
        wrong = np.flatnonzero(words[end:stop] != words[end + period : stop + period])
        if len(wrong):
            end += int(wrong[0])
            break
        end, step = stop, step * 2
    start, step = place, 64
    while start > 0:
        stop = max(0, start - step)
        wrong = np.flatnonzero(words[stop:start] != words[stop + period : start + period])
        if len(wrong):
            start = stop + int(wrong[-1]) + 1
            break
        start, step = stop, step * 2
    return start, end


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers (the finalizer of SplitMix64)."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(left) ^ (right * _MIX[0] + _ODD))


def _gram_names(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k words in a row: grams of 1, 2, 4, ... words, and two of these that overlap to k words."""
    names, width = _mixed(words.astype(np.uint64)), 1
    while 2 * width <= k:
        names = _joined(names[:-width], names[width:]) if len(names) > width else names[:0]
        width *= 2
    if width < k:
        names = _joined(names[: -(k - width)], names[k - width :]) if len(names) > k - width else names[:0]
    return names


def _minimizers(names: np.ndarray, window: int) -> np.ndarray:
    """Places that are least in one of the windows they lie in."""
    if len(names) < window:
        return np.empty(0, np.int64)
    least = _slid(names, window, np.minimum, np.iinfo(np.uint64).max)
    # A place is kept if the largest of the least names of its windows is its own.
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    return np.flatnonzero(_slid(padded, window, np.maximum, 0) == names)


def _slid(values: np.ndarray, window: int, best: np.ufunc, none: int) -> np.ndarray:
    """The best of every window, from running bests of blocks to the left and to the right."""
    rows = -(-len(values) // window)
    blocks = np.full(rows * window, none, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(rows, window)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - window + 1
    return best(behind[:count], ahead[window - 1 : window - 1 + count])


def repeats_dropped(words: np.ndarray, bounds: np.ndarray, runs: list[list[Run]]) -> np.ndarray:
    """For every place whether it stays: all but what follows the first period of a run."""
    step = np.zeros(len(words) + 1, np.int64)
    for first, found in zip(bounds[:-1].tolist(), runs, strict=True):
        for start, length, period in found:
            step[first + start + period] += 1
            step[first + start + length] -= 1
    return np.cumsum(step[:-1]) == 0


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reorder: Reorder | None = None) -> DataFrame:
    """One row per row of ``docs``, see ``SCHEMA``: its runs, the longest of them, and its text without the repeats.

    ``reorder(doc_id, number of words)`` may give places of words that take the place of the text's words.
    """
    prepare(docs.sparkSession)
    plain = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, offsets in slices(batches, size=SLICE):
            yield _slice_result(rows, flat, offsets, reorder)

    return plain.mapInArrow(work, SCHEMA.format(id=kind))


def _slice_result(rows: pa.RecordBatch, flat: np.ndarray, offsets: np.ndarray, reorder: Reorder | None) -> pa.RecordBatch:
    names, words, bounds = split_words(flat, offsets)
    if reorder:
        for i, doc_id in enumerate(rows.column("doc_id").to_pylist()):
            a, b = int(bounds[i]), int(bounds[i + 1])
            places = reorder(doc_id, b - a)
            if places is not None:
                words[a:b] = words[a + places]
    runs = find_runs(words, bounds)
    stays = repeats_dropped(words, bounds, runs)
    kept = np.concatenate([[0], np.cumsum(stays)])[bounds]
    lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), names.take(pa.array(words[stays])).cast(pa.large_string()).cast(pa.string()))
    best = [max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None) for found in runs]
    items = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs], RUNS)
    longest = [pa.array([b[i] for b in best], pa.int64()) for i in range(3)]
    milli = pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            rows.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array([len(r) for r in runs], pa.int64()),
            *longest, milli, items, pc.binary_join(lists, " "),
        ],
        names=["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"],
    )


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
