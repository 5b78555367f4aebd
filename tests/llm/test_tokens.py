import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from eventlens.llm import packing, piece_transducer, token_counts
from tests.llm.conftest import ODD

ALPHABET = "aabcdeehinorst  \n\t.,'é▁12ß漢😀́İΣ<|>"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def whole_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=ALPHABET, max_size=60) | st.text(max_size=30))
def test_ids_by_word_equal_ids_of_the_whole(tokenizer, text):
    data = text.encode("utf-8", "replace")
    ids, bounds = packing.encoder(packing.default_tokenizer()).rows(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert [*ids.tolist(), 0] == whole_ids(tokenizer, data.decode("utf-8", "replace"))
    assert bounds.tolist() == [0, len(ids)]


def check_packed(found, rows, tokenizer, capacity):
    pieces, ids = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        ids[r.sequence_id].append(r)
    for own in ids.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = Counter()
    for i, text in rows:
        own = np.array(whole_ids(tokenizer, text), "<u4")
        for k, start in enumerate(range(0, len(own), capacity)):
            part = own[start : start + capacity]
            want[i, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    return len(ids), sum(r.length for r in found)


@pytest.mark.parametrize("items", [packing.ITEMS, 7])
def test_packing_keeps_every_id_and_fills_sequences(documents, tokenizer, items):
    rnd = random.Random(4)
    rows = [(100 + i, " ".join(rnd.choice(["the", "of", "strange", "x1"]) for _ in range(rnd.randint(0, 90)))) for i in range(300)] + ODD
    found = packing.pack(documents(rows), capacity=64, items=items).collect()
    used, total = check_packed(found, rows, tokenizer, 64)
    assert used <= -(-total // 64) * (1.02 if items > 7 else 1.1) + 1


def test_packing_where_nothing_fits_together(documents, tokenizer):
    rows = [(i, "the " * 39) for i in range(40)]
    found = packing.pack(documents(rows), capacity=64, items=5).collect()
    assert check_packed(found, rows, tokenizer, 64)[0] == 40
    assert packing.pack(documents(rows).limit(0)).count() == 0


def test_best_fit_takes_the_fullest_bin_that_fits():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8] and fills.tolist() == [10, 10]


@pytest.fixture(scope="module")
def vocabulary():
    with open(packing.default_tokenizer(), encoding="utf-8") as file:
        return set(json.load(file)["model"]["vocab"])


def longest_first(word, vocabulary):
    at = count = 0
    while at < len(word):
        at = next(j for j in range(len(word), at, -1) if word[at:j] + ("</w>" if j == len(word) else "") in vocabulary)
        count += 1
    return count


@settings(max_examples=200, deadline=None)
@given(word=st.text(alphabet="abcdehinorst!1", min_size=1, max_size=25))
def test_automaton_counts_longest_matches(vocabulary, word):
    assert token_counts.counter(packing.default_tokenizer()).match.count(word) == longest_first(word, vocabulary)


def test_small_automaton():
    match = token_counts.LongestMatch([*"abc", *[f"{c}</w>" for c in "abc"], "ab", "abc", "bcab", "abcab</w>"])
    for word, count in {"abcab": 1, "abcabc": 3, "ab": 2, "abb": 2, "bcabc": 2, "c": 1}.items():
        assert match.count(word) == count, word
    with pytest.raises(ValueError):
        token_counts.LongestMatch(["ab"])


def test_counts_of_texts(documents, tokenizer, vocabulary):
    def count(text):
        words = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text or ""))
        return len(words), sum(longest_first(w, vocabulary) for w, _ in words)

    rows = [r for r in ODD if r[0] != 9]
    found = token_counts.count_tokens(documents(rows)).collect()
    assert Counter(map(tuple, found)) == Counter((i, *count(t)) for i, t in rows)
    assert token_counts.count_tokens(documents(rows).limit(0)).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=piece_transducer.default_model())


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=ALPHABET, max_size=50) | st.text(max_size=20))
def test_path_is_the_librarys_encoding(pieces, text):
    data = text.encode("utf-8", "replace")
    text = data.decode()
    machine = piece_transducer.transducer(piece_transducer.default_model())
    ids, bounds = machine.encode_rows(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert ids.tolist() == pieces.encode(text)
    back, ends = machine.decode_rows(ids, bounds)
    assert back.tobytes().decode() == text.replace("▁", " ")


def test_sentencepiece_tables(documents, pieces):
    rows = [r for r in ODD if r[0] != 9]
    docs = documents(rows)
    encoded = piece_transducer.encode(docs)
    assert Counter((r.doc_id, tuple(r.ids) if r.ids is not None else None) for r in encoded.collect()) == Counter(
        (i, tuple(pieces.encode(t)) if t is not None else None) for i, t in rows
    )
    assert Counter(map(tuple, piece_transducer.decode(encoded).collect())) == Counter(rows)
    trips = piece_transducer.round_trips(docs).collect()
    want = Counter((i, len(e), zlib.crc32(np.array(e, "<u4").tobytes()), len((t or "").encode()), True) for i, t in rows for e in [pieces.encode(t or "")])
    assert Counter(map(tuple, trips)) == want
    assert piece_transducer.round_trips(docs.limit(0)).count() == 0
