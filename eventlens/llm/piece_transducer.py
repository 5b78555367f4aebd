"""SentencePiece encoding and decoding by a weighted transducer.

A model file is compiled to four machines: the normaliser (blank to the mark, a mark in front), a lexicon
that reads the characters of a piece and writes its id at the piece's weight, byte fallback for characters
without a piece, and, for models of merged pairs, an acceptor of neighbours: id b may follow id a if merging
the characters of both alone ends in just a and b. A text is the merging of its characters exactly if all
its neighbours are of that kind, because merges inside two neighbours never depend on what is around them.
An input is composed with the machines on the fly, and the path of least weight (tropical semiring: minimum
over paths, sum along a path) is its encoding. For unigram models there is no acceptor and the same path is
the best segmentation.

An input is cut between characters that no piece holds together (before a mark, around a line end, before
a comma), which no path crosses; the parts repeat across texts and each is composed once per task and slice.

Cases: a null text gives null ids and an empty one no ids. Texts of any length are composed part by part.
Invalid bytes among ids decode to replacement characters. Repeated rows are encoded each; an empty table
gives an empty result. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.texts import distinct_pieces, prepare, slices, spread

MARK = "▁"
# Weight of a byte, as far from any piece as the library's own penalty for unknown characters.
BYTE_WEIGHT = 10.0
# Parts of text whose ids a Python worker remembers.
REMEMBERED = 800_000
# Neighbours whose test a Python worker remembers.
PAIRS = 1_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only the identity normaliser is compiled")
        if model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and pair-merging models are compiled")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.merging = model.trainer_spec.model_type == 2
        self.text, self.weight, self.ids = {}, {}, {}
        self.byte_ids = [-1] * 256
        written = []
        for i, piece in enumerate(model.pieces):
            if piece.type == kinds.BYTE:
                self.byte_ids[int(piece.piece[3:5], 16)] = i
                written.append(bytes([int(piece.piece[3:5], 16)]))
            elif piece.type == kinds.NORMAL:
                self.text[i], self.weight[i], self.ids[piece.piece] = piece.piece, -piece.score, i
                written.append(piece.piece.replace(MARK, " ").encode())
            elif piece.type in (kinds.CONTROL, kinds.UNKNOWN):
                written.append(" ⁇ ".encode() if piece.type == kinds.UNKNOWN else b"")
            else:
                raise ValueError(f"pieces of this kind aren't compiled: {piece.piece}")
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no byte fallback")
        self.characters = {p for p in self.ids if len(p) == 1}
        self.joined = self._joined()
        self.written = np.frombuffer(b"".join(written), np.uint8)
        self.written_size = np.array([len(w) for w in written], np.int64)
        self.written_first = np.cumsum(self.written_size) - self.written_size
        self.arcs: list[dict[str, int]] = [{}]
        self.ends = [-1]
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                if c not in self.arcs[node]:
                    self.arcs[node][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(-1)
                node = self.arcs[node][c]
            self.ends[node] = i
        self.pairs: dict[int, bool] = {}
        self.known: dict[bytes, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that remain when the best neighbours (the left ones of equals) are merged until none can be."""
        parts = list(text)
        while len(parts) > 1:
            options = [(-self.weight[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not options:
                break
            k = -max(options)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether the acceptor has an arc from a to b; a is -1 at the start of a part and behind bytes."""
        key = (a + 1) * len(self.written_size) + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            if a < 0:
                found = self.merged(self.text[b]) == [self.text[b]]
            else:
                both = self.text[a] + self.text[b]
                found = both not in self.ids and self.merged(both) == [self.text[a], self.text[b]]
            self.pairs[key] = found
        return found

    def shortest(self, part: str) -> list[int]:
        """The ids along the lightest path through the composition with one part."""
        arcs, ends, weight, merging, pairs = self.arcs, self.ends, self.weight, self.merging, self.pairs
        size, base = len(part), len(self.written_size)
        # At every place: state of the acceptor -> (weight so far, place before, state before, ids written).
        reached: list[dict[int, tuple]] = [{} for _ in range(size + 1)]
        reached[0][-1] = (0.0, -1, -1, ())
        for at in range(size):
            here = reached[at]
            if not here:
                continue
            if part[at] not in self.characters:
                code = part[at].encode("utf-8", "replace")
                best = min(here, key=lambda s: here[s][0])
                # Only this arc leads past such a character.
                reached[at + 1][-1] = (here[best][0] + BYTE_WEIGHT * len(code), at, best, tuple(self.byte_ids[x] for x in code))
                continue
            node = 0
            for to in range(at, size):
                node = arcs[node].get(part[to], 0)
                if not node:
                    break
                piece = ends[node]
                if piece < 0:
                    continue
                there = reached[to + 1]
                for state, found in here.items():
                    if merging:
                        fits = pairs.get((state + 1) * base + piece)
                        if not (self.follows(state, piece) if fits is None else fits):
                            continue
                    total, after = found[0] + weight[piece], piece if merging else -1
                    old = there.get(after)
                    if old is None or total < old[0]:
                        there[after] = (total, at, state, (piece,))
        path, at, state = [], size, min(reached[size], key=lambda s: reached[size][s][0])
        while at > 0:
            _, at, state, written = reached[at][state]
            path.append(written)
        return [i for written in reversed(path) for i in written]

    def _joined(self) -> np.ndarray:
        """Whether some piece holds byte b behind byte a, a mark being a blank or its own bytes; elsewhere input may be cut."""
        joined = np.zeros((256, 256), bool)
        for piece in self.ids:
            code = np.frombuffer(piece.replace(MARK, " ").encode(), np.uint8)
            joined[code[:-1], code[1:]] = True
        first, *_, last = MARK.encode()
        joined[last] |= joined[0x20]
        joined[:, first] |= joined[:, 0x20]
        joined[:, 0x80:0xC0] = True  # inside a character
        return joined

    def starts(self, flat: np.ndarray) -> np.ndarray:
        """Where parts of normalised input start: between bytes that no piece holds together."""
        starts = np.empty(len(flat), bool)
        starts[0] = True
        starts[1:] = ~self.joined[flat[:-1], flat[1:]]
        return starts

    def encode_rows(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and the bounds of its rows in them."""
        flat, offsets = self.normalise(flat, offsets)
        parts, at, bounds = distinct_pieces(flat, offsets, self.starts)
        known, coded = self.known, []
        if len(known) > REMEMBERED:
            known = self.known = {part: known[part] for part in parts if part in known}
        for part in parts:
            ids = known.get(part)
            if ids is None:
                ids = known[part] = np.array(self.shortest(part.decode("utf-8", "replace").replace(" ", MARK)), "<u4").tobytes()
            coded.append(ids)
        ids = np.frombuffer(b"".join(coded), "<u4")
        sizes = np.array([len(c) // 4 for c in coded], np.int64)
        lengths = sizes[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return ids[spread(lengths, (np.cumsum(sizes) - sizes)[at])], ends[bounds]

    def normalise(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A blank in front of every row that isn't empty; blanks stand for marks until they are composed."""
        if not self.prefix:
            return flat, offsets
        filled = np.diff(offsets) > 0
        after = offsets + np.concatenate(([0], np.cumsum(filled)))
        out = np.full(int(after[-1]), 0x20, np.uint8)
        sizes = np.diff(offsets)
        out[spread(sizes, after[:-1] + filled)] = flat
        return out, after

    def decode_rows(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The inverse transducer: bytes of all rows and their offsets, without the blank in front."""
        sizes = self.written_size[ids]
        firsts = self.written_first[ids]
        if self.prefix:
            own = np.flatnonzero(np.diff(bounds) > 0)
            lead = bounds[own]
            lead = lead[(sizes[lead] > 0) & (self.written[firsts[lead]] == 0x20)]
            sizes[lead] -= 1
            firsts[lead] += 1
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.written[spread(sizes, firsts)], ends[bounds]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _read(docs: DataFrame, id_column: str, column: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{column}`").alias(column))


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, ids for every row."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, offsets in slices(batches, text_column):
            ids, bounds = transducer(path).encode_rows(flat, offsets)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            texts = rows.column(text_column)
            lists = lists.take(pa.array([i if v else None for i, v in enumerate(texts.is_valid().to_pylist())], pa.int64())) if texts.null_count else lists
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], names=["doc_id", "ids"])

    return _read(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id, text for every row of ids."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column(ids_column)
            sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, offsets = transducer(path).decode_rows(ids, np.concatenate(([0], np.cumsum(sizes))))
            data, ends = flat.tobytes(), offsets.tolist()
            texts = [data[a:b].decode("utf-8", "replace") if v else None for a, b, v in zip(ends, ends[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _read(encoded, id_column, ids_column).mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), n_bytes (decoded), round_trip, of ids encoded and decoded in one pass."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for rows, flat, offsets in slices(batches, text_column):
            ids, bounds = machine.encode_rows(flat, offsets)
            back, ends = machine.decode_rows(ids, bounds)
            data, own, decoded = ids.tobytes(), flat.tobytes(), back.tobytes()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            same = [own[a:b] == decoded[c:d] for a, b, c, d in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(np.diff(ends)), pa.array(same)],
                names=["doc_id", "n_ids", "ids_crc32", "n_bytes", "round_trip"],
            )

    return _read(docs, id_column, text_column).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_bytes long, round_trip boolean")
