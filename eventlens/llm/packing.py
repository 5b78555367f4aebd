"""Best-fit packing: documents as token ids into sequences of fixed length, packed in rounds.

Each task turns its documents into ids, cuts those longer than a sequence, and packs its own pieces by
best fit, longest first. Sequences with a few free places at most are done. The others become
items of the next round: they are dealt to tasks of at most ``ITEMS`` items and packed again whole, round
after round, until one task holds all that is left or a round gains nothing. What moves between tasks is
the place of a piece, never its ids. Every round is a table in the shared folder, so a lost executor
costs one task, and no row is ever packed twice.

Cases: a null or empty text is the one id 0. Rows with the same id are packed as rows of their own. An
empty table gives an empty result. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.texts import after_blank, distinct_pieces, lowered, plain_word, prepare, released, slices, spread, word_starts
from eventlens.session import settle

CAPACITY = 2048
# Free places up to which a sequence counts as full.
SLACK = 4
# Items that one task packs in a later round.
ITEMS = 50_000
# Pieces of text whose ids a Python worker remembers.
REMEMBERED = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts. The tokenizer drops white space and never looks across it, so words repeat and are encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # For words that need no normalising or splitting, many at once: each word's last id marks its end.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.special = [t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()]
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of every piece, as little-endian 32-bit numbers."""
        known = self.known
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > REMEMBERED:
            known = self.known = {p: known[p] for p in pieces if p in known}
        words, rest = [], []
        for piece in new:
            text = piece.decode("utf-8", "replace")
            word = plain_word(text)
            if word is None:
                rest.append((piece, text))
            else:
                words.append((piece, word))
        if words:
            joined = self.plain.encode_batch_fast([" ".join(w for _, w in words)], add_special_tokens=False)[0]
            ids = np.array(joined.ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            known.update((p, data[a:b]) for (p, _), a, b in zip(words, [0, *stops[:-1]], stops, strict=True))
        found = self.whole.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
        known.update((p, np.array(e.ids, "<u4").tobytes()) for (p, _), e in zip(rest, found, strict=True))
        return [known[p] for p in pieces]

    def rows(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and the bounds of its rows in them."""
        small = lowered(flat)
        data = small.tobytes()
        if any(name in data for name in self.special):  # these count as written, in one piece
            pieces, at, bounds = distinct_pieces(flat, offsets, after_blank)
        else:
            pieces, at, bounds = distinct_pieces(small, offsets, word_starts)
        coded = self.pieces(pieces)
        ids = np.frombuffer(b"".join(coded), "<u4")
        sizes = np.array([len(c) // 4 for c in coded], np.int64)
        lengths = sizes[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return ids[spread(lengths, (np.cumsum(sizes) - sizes)[at])], ends[bounds]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin; longest first, into the bin it leaves least room in."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    fills: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, bin_ = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = bin_, capacity - room
        fills[bin_] += size
        left = room - size
        if left:
            by_room[left].append(bin_)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None,
    items: int = ITEMS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or default_tokenizer()
    schema = f"{PIECES}, fill long"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = [], []
        for rows, flat, offsets in slices(batches):
            ids, bounds = encoder(path).rows(flat, offsets)
            data = ids.tobytes()
            source, found = [], []
            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own = data[4 * a : 4 * b] + b"\0\0\0\0"
                for piece, start in enumerate(range(0, len(own) // 4, capacity)):
                    part = own[4 * start : 4 * (start + capacity)]
                    source.append(row)
                    found.append((piece, start, len(part) // 4, zlib.crc32(part)))
            names.append(rows.column("doc_id").take(pa.array(source, pa.int64())))
            numbers.append(np.array(found, np.int64))
        encoder(path).known.clear()
        if names:
            all_numbers = np.concatenate(numbers)
            bins, places, fills = best_fit(all_numbers[:, 2], capacity)
            base = TaskContext.get().partitionId() << 32
            yield _rows(pa.concat_arrays(names), all_numbers, bins + base, places, fills[bins])

    read = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    packed = settle(read.mapInArrow(released(first), schema))
    done = packed.where(F.col("fill") >= capacity - SLACK).select(*COLUMNS)
    loose = packed.where(F.col("fill") < capacity - SLACK)
    left, number = loose.where(F.col("offset") == 0).count(), 0
    while left:
        number += 1
        groups = -(-left // items)
        packed = settle(_repack(loose, groups, number, capacity, schema))
        done = done.unionByName(packed.where(F.col("fill") >= capacity - SLACK).select(*COLUMNS))
        loose = packed.where(F.col("fill") < capacity - SLACK)
        before, left = left, loose.where(F.col("offset") == 0).count()
        if groups == 1 or left == before:
            return done.unionByName(loose.select(*COLUMNS))
    return done


def _repack(loose: DataFrame, groups: int, number: int, capacity: int, schema: str) -> DataFrame:
    """Sequences as items, packed group by group; the pieces of one stay together and move as a block."""

    def again(rows: pa.Table) -> pa.Table:
        group = rows.column("group")[0].as_py()
        old, fills = rows.column("sequence_id").to_numpy(), rows.column("fill").to_numpy()
        _, firsts, item = np.unique(old, return_index=True, return_inverse=True)
        bins, places, full = best_fit(fills[firsts], capacity)
        numbers = np.column_stack([rows.column(c).to_numpy() for c in ("piece", "start", "length", "ids_crc32")])
        offsets = rows.column("offset").to_numpy() + places[item]
        base = (number << 54) + (group << 32)
        return pa.Table.from_batches([_rows(rows.column("doc_id").combine_chunks(), numbers, bins[item] + base, offsets, full[bins[item]])])

    keyed = loose.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    return keyed.groupBy("group").applyInArrow(again, schema)


def _rows(names: pa.Array, numbers: np.ndarray, sequence: np.ndarray, offset: np.ndarray, fill: np.ndarray) -> pa.RecordBatch:
    piece, start, length, crc = numbers.T
    return pa.RecordBatch.from_arrays(
        [names, pa.array(piece.astype(np.int32)), *map(pa.array, map(np.ascontiguousarray, (start, length, crc, sequence, offset, fill)))],
        names=[*COLUMNS, "fill"],
    )
