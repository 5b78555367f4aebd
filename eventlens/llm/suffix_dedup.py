"""Suffix-array dedup: every byte that a string of ``LENGTH`` bytes covers which starts earlier elsewhere is removed.

Merging Burrows-Wheeler transforms needs all suffixes that may be equal in one place, so the text is first
cut to the parts where repeats end or differ, by fingerprints that lose nothing:

1. Every window of LENGTH bytes names an anchor, its ANCHOR bytes with the least hash. Equal windows have equal
   anchors, and neighbouring windows mostly share one: together they are a run, about one per 40 bytes. A run
   goes to its anchor's hash with a fingerprint of all its bytes. Of equal runs the earliest stays and the
   others are repeats; a task settles those of its own rows before the shuffle. An anchor with one kind of run
   is done.
2. Runs that share an anchor and differ are cut by the anchor's place in the window into classes. All windows
   of a class hold the same core around the anchor; what is left of a run is at most LENGTH - CORE bytes on
   either side of it. These strings, with the core as one symbol, go to the core's fingerprint.
3. There the strings form shards, each with its own transform. The shards' transforms are merged by iterative
   interleave refinement: round k orders all suffixes by k symbols, by one stable sort of the symbols before
   them, and no suffix is compared or sorted again. Where two neighbours first part in round k their common
   prefix is k long; what has not parted after LENGTH - CORE + 1 symbols is a repeated interval. In it, every
   window but the earliest is a repeat.
4. A core that more than HOT strings share is cut further, to single windows, which meet by their content
   with the earliest one found in the map tasks.

Removed bytes are the union of the repeats, judged on the input alone.

Cases: null counts as empty; texts under LENGTH bytes never lose a byte. Order is (doc_id, start). Rows that
repeat an id with its text are one document, each reported; an id that comes with several texts, or none, has a
document for each of them, in the order of their SHA-256, and rows without an id come first (``row_ids``). An empty
table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.near_dedup import mixed, powers
from eventlens.llm.row_ids import keyed
from eventlens.llm.texts import prepare, released, slices, spread
from eventlens.session import settle

LENGTH = 100
ANCHOR = 21
# Anchor places per class; windows of a class share CORE bytes and have SIDE more on both sides together.
CLASS = 20
SIDE = CLASS - 1
CORE = LENGTH - SIDE
PLACES = LENGTH - ANCHOR + 1
# Bytes per step, and windows per step of a single text.
STEP = 1 << 20
# Strings of one core that are merged in one task, and strings merged at once.
HOT = 20_000
MERGED = 10_000
SHARDS = 8

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PLACE_BITS = 24


class Fingerprints:
    """Hashes of any substring of one array of bytes."""

    def __init__(self, flat: np.ndarray):
        self.back = powers(INVERSE, len(flat) + 1)
        self.total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + U(1)) * powers(BASE, len(flat)), out=self.total[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start])


def runs(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every run: row, first window, number of windows, anchor's place from the first window, anchor's and run's fingerprints."""
    empty = np.empty(0, np.int64)
    if len(flat) < LENGTH:
        return empty, empty, empty, empty, empty.astype(U), empty.astype(U)
    prints = Fingerprints(flat)
    grams = mixed((prints.total[ANCHOR:] - prints.total[:-ANCHOR]) * prints.back[: len(flat) - ANCHOR + 1])
    # The least hash of PLACES neighbours, by doubling; the place below the hash makes the first of equals the least.
    place = U((1 << PLACE_BITS) - 1)
    least = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < PLACES:
        least = np.minimum(least[: len(least) - (PLACES - width)], least[PLACES - width :])
    windows = np.maximum(0, np.diff(offsets) - LENGTH + 1)
    row = np.repeat(np.arange(len(windows)), windows)
    start = spread(windows, offsets[:-1])
    anchor = (least[start] & place).astype(np.int64)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    firsts = np.flatnonzero(fresh)
    row, start, anchor = row[firsts], start[firsts], anchor[firsts]
    count = np.diff(np.append(firsts, len(fresh)))
    lead = anchor - start
    whole = prints.between(start, start + count - 1 + LENGTH)
    return row, start - offsets[row], count, lead, grams[anchor], mixed(whole ^ (lead * 256 + count).astype(np.uint64))


def packed(start: np.ndarray, lead: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run's place in one number that sorts as its start; spans of repeats are negative instead, with their length elsewhere."""
    return (start << 16) | (lead << 8) | count


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a task's texts, and its own repeats as spans."""
    found: list[tuple[np.ndarray, ...]] = []
    for rows, flat, offsets in slices(batches, size=STEP):
        ids = rows.column("id").to_numpy()
        # A long text goes in parts, which overlap by a window less one byte.
        bounds = [(offsets, flat, 0)]
        if len(ids) == 1 and len(flat) > 2 * STEP:
            bounds = [(None, flat[a : a + STEP + LENGTH - 1], a) for a in range(0, len(flat) - LENGTH + 1, STEP)]
        for ends, part, base in bounds:
            row, start, count, lead, anchor, whole = runs(part, np.array([0, len(part)]) if ends is None else ends)
            found.append((anchor.view(np.int64), whole.view(np.int64), ids[row], packed(start + base, lead, count)))
    if not found:
        return
    anchor, whole, ids, place = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((place, ids, whole, anchor))
    same = (anchor[order][1:] == anchor[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    first = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0)) if len(order) else order
    first = order[first]
    repeat = (ids[order] != ids[first]) | (place[order] != place[first])
    again = np.zeros(len(order), bool)
    again[order[repeat]] = True
    dropped = np.zeros(len(order), bool)
    dropped[order[1:][same]] = True
    own = ~dropped
    spans = joined_spans(ids[again], place[again] >> 16, (place[again] >> 16) + (place[again] & 255) - 1 + LENGTH)
    yield from _batches([anchor[own], whole[own], ids[own], place[own]], ["anchor", "whole", "id", "place"])
    yield from _batches(
        [mixed(spans[0].view(np.uint64)).view(np.int64), spans[2] - spans[1], spans[0], -1 - spans[1]], ["anchor", "whole", "id", "place"]
    )


def joined_spans(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order, those of an id that meet or overlap as one."""
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], end[order]
    if not len(ids):
        return ids, start, end
    group = np.concatenate(([True], ids[1:] != ids[:-1]))
    # The furthest end so far within an id: ends are raised by the id's number to keep ids apart.
    number = np.cumsum(group) - 1
    reach = np.maximum.accumulate(end + (number << 32)) - (number << 32)
    fresh = group.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    firsts = np.flatnonzero(fresh)
    lasts = np.append(firsts[1:], len(ids)) - 1
    return ids[firsts], start[firsts], reach[lasts]


def _batches(columns: list[np.ndarray], names: list[str], size: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + size]) for c in columns], names=names)


def _settled_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor, whole, id, place: repeated runs become spans, and of an anchor with several kinds the first of each goes on.

    Between batches only the first run of the last anchor and of the last kind are held.
    """
    held = np.empty((0, 4), np.int64)
    waiting = False  # the first held run hasn't gone on yet
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([batch.column(c).to_numpy() for c in ("anchor", "whole", "id", "place")])
        span = rows[:, 3] < 0
        if span.any():
            own = rows[span]
            yield _row_batch(own[:, 0], own[:, 2], -1 - own[:, 3], own[:, 1], np.ones(len(own), bool))
            rows = rows[~span]
        if not len(rows):
            continue
        old = len(held)
        rows = np.concatenate((held, rows))
        new_anchor = np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))
        new_kind = new_anchor | np.concatenate(([True], rows[1:, 1] != rows[:-1, 1]))
        at = np.arange(len(rows))
        first = np.maximum.accumulate(np.where(new_kind, at, 0))
        head = np.maximum.accumulate(np.where(new_anchor, at, 0))
        repeat = ~new_kind & ((rows[:, 2] != rows[first, 2]) | (rows[:, 3] != rows[first, 3]))
        own = rows[repeat]
        start = own[:, 3] >> 16
        yield _row_batch(own[:, 0], own[:, 2], start, (own[:, 3] & 255) - 1 + LENGTH, np.ones(len(own), bool))
        goes = new_kind & ~new_anchor
        goes[:old] = False
        several = np.zeros(len(rows), bool)
        several[head[goes]] = True
        before = waiting if old and head[-1] == 0 else True
        if old:
            several[0] &= waiting
        waiting = before and not several[head[-1]]
        own = rows[goes | several]
        yield _row_batch(own[:, 0], own[:, 2], own[:, 3], np.zeros(len(own), np.int64), np.zeros(len(own), bool))
        held = rows[[head[-1]]] if first[-1] == head[-1] else rows[[head[-1], first[-1]]]


def _row_batch(anchor: np.ndarray, ids: np.ndarray, place: np.ndarray, size: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(map(pa.array, map(np.ascontiguousarray, (anchor, ids, place, size, span)))), names=["anchor", "id", "place", "size", "span"])


RUNS = "anchor long, id long, place long, size long, span boolean"
STRINGS = "anchor long, core long, id long, start long, before binary, after binary"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their open runs, as strings per class: the bytes before and after the core."""
    for rows, flat, offsets in slices(batches, size=STEP):
        lists = rows.column("open")
        sizes = np.diff(lists.offsets.to_numpy())
        fields = lists.flatten()
        anchor, place = fields.field("anchor").to_numpy(), fields.field("place").to_numpy()
        row = np.repeat(np.arange(rows.num_rows), sizes)
        start = offsets[row] + (place >> 16)
        end = start + (place & 255) - 1
        # A row that repeats the id with another text may be shorter.
        inside = end + LENGTH <= offsets[row + 1]
        anchor, row, start, end, lead = anchor[inside], row[inside], start[inside], end[inside], ((place >> 8) & 255)[inside]
        at = start + lead
        prints = Fingerprints(flat)
        ids = rows.column("id").to_numpy()
        for low in range(0, PLACES, CLASS):
            high = low + CLASS - 1
            x, y = np.maximum(start, at - high), np.minimum(end, at - low)
            own = np.flatnonzero(x <= y)
            if not len(own):
                continue
            x, y = x[own], y[own]
            left, right = at[own] - low, at[own] - high + LENGTH
            core = mixed(prints.between(left, right) + U(low)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[own]), pa.array(core), pa.array(ids[row[own]]), pa.array(x - offsets[row[own]]),
                 _bytes(flat, x, left), _bytes(flat, right, y + LENGTH)],
                names=["anchor", "core", "id", "start", "before", "after"],
            )


def _bytes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    sizes = end - start
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat[spread(sizes, start)])])


def transform(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of strings, each closed by an end (0) of its own, and the place of every suffix in its order.

    ``symbols`` holds the strings one after the other, each with its end; suffixes are ranked by doubling.
    """
    size, count = len(symbols), len(bounds) - 1
    ends = bounds[1:] - 1
    rank = symbols.astype(np.int64) + count
    rank[ends] = np.arange(count)
    last = np.repeat(ends, np.diff(bounds))
    step = 1
    while True:
        after = np.arange(size) + step
        key = rank * (size + count + 65536 + 1) + np.where(after <= last, rank[np.minimum(after, size - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        fresh = np.ones(size, bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            break
        step *= 2
    before = order - 1
    starts = np.zeros(size, bool)
    starts[bounds[:-1]] = True
    return np.where(starts[order], 0, symbols[before]).astype(np.uint16), order


def merge(transforms: list[np.ndarray], ends: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms by interleave refinement: the source row of every merged row, and the common prefix with the row before, up to ``depth``.

    ``ends[s]`` is the number of strings of transform s. Before round k the interleave orders all rows by
    their first k symbols; a stable sort by the symbol before each row orders the rows they lead to by k + 1.
    """
    sizes = [len(t) for t in transforms]
    total = sum(sizes)
    symbols = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint8), sizes)
    closing = np.repeat(np.arange(len(sizes), dtype=np.uint8), ends)
    block = np.zeros(total, np.int64)
    common = np.full(total, -1, np.int64)
    source = np.arange(total)
    for k in range(depth):
        # A shard's rows keep their order, so the interleave alone says which row stands where.
        source[np.argsort(shard, kind="stable")] = np.arange(total)
        before = symbols[source]
        order = np.argsort(before, kind="stable")
        shard = shard[order]
        shard[: len(closing)] = closing
        symbol, old = before[order], block[order]
        parted = np.ones(total, bool)
        parted[1:] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1]) | (symbol[1:] == 0)
        common[parted & (common < 0)] = k
        block = np.cumsum(parted) - 1
        if block[-1] == total - 1:
            break
    common[common < 0] = depth
    source[np.argsort(shard, kind="stable")] = np.arange(total)
    return source, common


def repeated_windows(group: np.ndarray, ids: np.ndarray, start: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(id, start) of every window of the strings that also starts earlier. ``group`` numbers the cores from 0."""
    shards, tables, places, strings, closing = np.abs(ids % SHARDS), [], [], [], []
    for s in range(SHARDS):
        own = np.flatnonzero(shards == s)
        if not len(own):
            continue
        sizes = np.array([len(before[i]) + len(after[i]) + 2 for i in own])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        text = np.frombuffer(b"".join(before[i] + b"\0" + after[i] + b"\0" for i in own), np.uint8).astype(np.uint16) + 1
        text[bounds[:-1] + [len(before[i]) for i in own]] = 257 + group[own]
        text[bounds[1:] - 1] = 0
        table, order = transform(text, bounds)
        string = np.searchsorted(bounds, order, side="right") - 1
        tables.append(table)
        strings.append(own[string])
        places.append(order - bounds[string])
        closing.append(len(own))
    source, common = merge(tables, closing, SIDE + 1)
    string, place = np.concatenate(strings)[source], np.concatenate(places)[source]
    interval = np.cumsum(common < SIDE + 1)
    many = np.bincount(interval)[interval] > 1
    string, place, interval = string[many], place[many], interval[many]
    owner, at = ids[string], start[string] + place
    order = np.lexsort((at, owner, interval))
    owner, at, interval = owner[order], at[order], interval[order]
    head = np.maximum.accumulate(np.where(np.concatenate(([True], interval[1:] != interval[:-1])), np.arange(len(order)), 0)) if len(order) else order
    again = (owner != owner[head]) | (at != at[head])
    return owner[again], at[again]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings in order of anchor and core: the spans of their repeated windows. Cores go in whole, MERGED strings or so at a time."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, core = rows.column("anchor").to_numpy(), rows.column("core").to_numpy()
        fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (core[1:] != core[:-1])))
        group = np.cumsum(fresh) - 1
        own = np.flatnonzero(np.bincount(group)[group] > 1)
        if len(own):
            rows = rows.take(pa.array(own))
            group = np.unique(group[own], return_inverse=True)[1]
            ids, start = repeated_windows(
                group, rows.column("id").to_numpy(), rows.column("start").to_numpy(), rows.column("before").to_pylist(), rows.column("after").to_pylist()
            )
            yield from _batches(list(joined_spans(ids, start, start + LENGTH)), ["id", "first", "stop"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, MERGED):
            held.append(batch.slice(at, MERGED))
            if sum(h.num_rows for h in held) <= MERGED:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            anchor, core = rows.column("anchor").to_numpy(), rows.column("core").to_numpy()
            # All but the last core, which may go on.
            whole = int(np.flatnonzero((anchor != anchor[-1]) | (core != core[-1]))[-1]) + 1 if ((anchor != anchor[-1]) | (core != core[-1])).any() else 0
            if whole:
                yield from work(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
    if held and sum(h.num_rows for h in held):
        yield from work(pa.Table.from_batches(held).combine_chunks())


def _windows_by_content(strings: DataFrame) -> DataFrame:
    """Spans of repeated windows of hot cores: every window is a row, and the earliest of equal ones comes from an aggregate."""
    count = F.octet_length("before") + F.octet_length("after") - SIDE + 1
    each = strings.withColumn("i", F.explode(F.sequence(F.lit(0), count - 1)))
    left = F.octet_length("before") - F.col("i")
    content = F.concat(
        F.expr("substring(before, i + 1)"), F.encode(F.lit("|"), "UTF-8"), F.substring(F.col("after"), F.lit(1), F.lit(SIDE) - left)
    )
    windows = each.select(
        "anchor", "core", left.alias("left"), F.sha2(content, 256).alias("content"), F.struct("id", (F.col("start") + F.col("i")).alias("first")).alias("at")
    )
    key = ["anchor", "core", "left", "content"]
    earliest = windows.groupBy(*key).agg(F.min("at").alias("earliest"))
    again = windows.join(earliest, key).where("at <> earliest")
    return again.select("at.id", "at.first", (F.col("at.first") + LENGTH).alias("stop"))


def repeats(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """id, first, stop: spans that cover all bytes to remove. ``texts`` has id (not null) and text."""
    rows = texts.mapInArrow(released(_runs_of), "anchor long, whole long, id long, place long")
    ordered = rows.repartition("anchor").sortWithinPartitions("anchor", "whole", "id", "place")
    settled = settle(ordered.mapInArrow(released(_settled_runs), RUNS))
    whole = settled.where("span").select("id", F.col("place").alias("first"), (F.col("place") + F.col("size")).alias("stop"))
    open_ = settled.where("not span").groupBy("id").agg(F.collect_list(F.struct("anchor", "place")).alias("open"))
    strings = settle(texts.join(open_.hint("merge"), "id").select("id", "text", "open").mapInArrow(released(_strings), STRINGS))
    crowded = strings.groupBy("anchor", "core").count().where(F.col("count") > hot).select("anchor", "core")
    few = strings.join(crowded, ["anchor", "core"], "left_anti").repartition("anchor", "core").sortWithinPartitions("anchor", "core")
    many = strings.join(crowded, ["anchor", "core"], "left_semi")
    return whole.unionByName(few.mapInArrow(released(_merged), "id long, first long, stop long")).unionByName(_windows_by_content(many))


def _kept(rows: pa.RecordBatch, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes stay, and how many maximal spans go, per row."""
    lists = rows.column("spans")
    sizes = np.diff(lists.offsets.to_numpy())
    if lists.null_count:
        sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    fields = lists.flatten()
    row = np.repeat(np.arange(rows.num_rows), sizes)
    first = np.minimum(offsets[row] + fields.field("first").to_numpy(), offsets[row + 1])
    stop = np.minimum(offsets[row] + fields.field("stop").to_numpy(), offsets[row + 1])
    change = np.bincount(first, minlength=len(flat) + 1) - np.bincount(stop, minlength=len(flat) + 1)
    gone = np.cumsum(change[:-1]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = gone[heads]
    total = np.concatenate(([0], np.cumsum(begins)))
    return ~gone, total[offsets[1:]] - total[offsets[:-1]]


def _with_spans(docs: DataFrame, texts: DataFrame, hot: int) -> DataFrame:
    """``docs`` with a last column, the spans to remove. Merge joins where texts move: the plan is the same at every size."""
    spans = repeats(texts, hot).groupBy("id").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    return docs.join(spans.hint("merge"), docs["id"] == spans["id"], "left").drop(spans["id"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    prepare(docs.sparkSession)
    plain = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    rows_, _ = keyed(plain, nulls_first=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, offsets in slices(batches):
            kept, spans = _kept(rows, flat, offsets)
            left = np.concatenate(([0], np.cumsum(kept)))[offsets]
            data = flat[kept].tobytes()
            digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(sizes), pa.array(sizes - np.diff(left)), pa.array(spans), pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    done = _with_spans(rows_, rows_.select("id", "text"), hot)
    return done.mapInArrow(released(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """All rows and columns of ``docs``, texts without their repeated bytes and n_chars, where there is one, counted anew.

    A character that loses some of its bytes goes whole. A null text stays null.
    """
    prepare(docs.sparkSession)
    plain = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wide, _ = keyed(plain, nulls_first=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, offsets in slices(batches):
            kept, _ = _kept(rows, flat, offsets)
            left = np.concatenate(([0], np.cumsum(kept)))[offsets].tolist()
            data = flat[kept].tobytes()
            valid = rows.column("text").is_valid().to_pylist()
            new = [data[a:b].decode("utf-8", "ignore") if v else None for a, b, v in zip(left, left[1:], valid, strict=False)]
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(new, pa.string())], names=["row", "text"])

    joined = _with_spans(wide.drop("doc_id"), wide.select("id", "text"), hot)
    schema = joined.select("row", "text").schema
    done = joined.mapInArrow(released(finish), schema)
    fresh = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*[fresh[c].alias(c) if fresh.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns])
