"""Token counts: greedy longest-match word pieces, counted in one pass over each word without building them.

The vocabulary is a trie over symbols. A symbol is a character of a word, or a word's last character, as
the vocabulary marks pieces that end a word. Every node knows a failure link and how many pieces are
popped on the way: where the next symbol has no arc, the longest piece from the front is certain, so
the count moves by the precomputed number and the walk goes on from the link. Each symbol is read once and
every failure step pops at least one piece, so the walk is linear in the word.

Cases: a null or empty text, and one of white space alone, has no tokens. Names of special tokens in a
text are ordinary text. Repeated rows are counted each. An empty table gives an empty result. Only id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventlens.llm.packing import REMEMBERED, default_tokenizer
from eventlens.llm.texts import distinct_pieces, lowered, plain_word, prepare, slices, sums, word_starts

WORD_END = "</w>"
# Symbols are characters of the vocabulary's alphabet, all below this, and the same again for last characters.
LAST = 1 << 10


class LongestMatch:
    """Trie, failure links and popped counts of a vocabulary."""

    def __init__(self, vocabulary: list[str]):
        self.arcs: dict[int, int] = {}
        ends = [False]
        below: list[list[tuple[int, int]]] = [[]]
        for token in vocabulary:
            node = 0
            for symbol in self.symbols_of(token):
                after = self.arcs.get(node * 2 * LAST + symbol)
                if after is None:
                    after = self.arcs[node * 2 * LAST + symbol] = len(ends)
                    below[node].append((symbol, after))
                    ends.append(False)
                    below.append([])
                node = after
            ends[node] = node > 0
        self.link, self.popped = [0] * len(ends), [0] * len(ends)
        waiting = deque([0])
        while waiting:
            parent = waiting.popleft()
            for symbol, node in below[parent]:
                waiting.append(node)
                if ends[node]:
                    self.popped[node] = 1
                    continue
                if not parent:
                    raise ValueError("every symbol of the alphabet has to be a piece")
                back, count = self.link[parent], self.popped[parent]
                while back and back * 2 * LAST + symbol not in self.arcs:
                    count += self.popped[back]
                    back = self.link[back]
                self.link[node], self.popped[node] = self.arcs[back * 2 * LAST + symbol], count

    @staticmethod
    def symbols_of(token: str) -> list[int]:
        if token.endswith(WORD_END) and token != WORD_END:
            *front, last = map(ord, token[: -len(WORD_END)])
            return [*front, last + LAST]
        return list(map(ord, token))

    def count(self, word: str) -> int:
        """The number of pieces of a word, which isn't empty."""
        arcs, link, popped = self.arcs, self.link, self.popped
        node = count = 0
        symbols = list(map(ord, word))
        symbols[-1] += LAST
        for symbol in symbols:
            after = arcs.get(node * 2 * LAST + symbol)
            while after is None:
                if not node:
                    raise ValueError(f"not in the alphabet: {word!r}")
                count += popped[node]
                node = link[node]
                after = arcs.get(node * 2 * LAST + symbol)
            node = after
        while node:
            count += popped[node]
            node = link[node]
        return count


class Counter:
    """Counts for pieces of text, by the tokenizer file's own normaliser, splitter and vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as file:
            self.match = LongestMatch(list(json.load(file)["model"]["vocab"]))
        self.known: dict[bytes, tuple[int, int]] = {}

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Words and tokens of every piece."""
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for piece in pieces:
            found = known.get(piece)
            if found is None:
                text = piece.decode("utf-8", "replace")
                word = plain_word(text)
                if word is not None and word.isascii():
                    found = (1, self.match.count(word))
                else:
                    words = self.split(self.normalise(text))
                    found = (len(words), sum(self.match.count(w) for w, _ in words))
                known[piece] = found
            out.append(found)
        return np.array(out, np.int64).reshape(-1, 2)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens for every row."""
    prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, offsets in slices(batches):
            pieces, at, bounds = distinct_pieces(lowered(flat), offsets, word_starts)
            words, tokens = sums(counter(path).counts(pieces)[at], bounds).T
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.ascontiguousarray(words)), pa.array(np.ascontiguousarray(tokens))],
                names=["doc_id", "n_words", "n_tokens"],
            )

    read = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return read.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
