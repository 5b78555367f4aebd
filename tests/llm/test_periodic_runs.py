import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from eventlens.llm import periodic_runs, queries
from tests.llm.conftest import ODD


def brute(words):
    """Every run by the definition: a longest stretch for each period, kept if no smaller period holds on it."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                run = words[i : i + length]
                if all(any(run[x] != run[x + r] for x in range(length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def facts(doc_id, text):
    words = split(text)
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def random_text(rnd):
    kind = rnd.randint(0, 5)
    if kind == 0:
        return " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))
    if kind == 1:
        base = [rnd.choice("abcdef") for _ in range(rnd.randint(1, 12))]
        return "x y " + " ".join(base * rnd.randint(1, 9)) + " z"
    if kind == 2:
        a, b = "a", "a b"
        for _ in range(rnd.randint(1, 7)):
            a, b = b, f"{b} {a}"
        return b
    if kind == 3:
        return "\t".join(str(rnd.randint(0, 2000)) for _ in range(rnd.randint(0, 200)))
    if kind == 4:  # runs inside a run's period
        inner = " ".join(["p q"] * rnd.randint(3, 6) + [str(rnd.randint(0, 3))])
        return f"{inner} " * rnd.randint(2, 6)
    return "one\ntwo\x0bthree \x0c" * rnd.randint(0, 9)


@pytest.mark.parametrize("direct", [0, 1, 2, 5, 64])
def test_runs_equal_their_definition(direct):
    rnd = random.Random(direct)
    texts = [random_text(rnd) for _ in range(250)]
    flat = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    names, words, bounds = periodic_runs.split_words(flat, offsets)
    assert [[w.decode() for w in names.take(words[a:b]).to_pylist()] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [split(t) for t in texts]
    assert periodic_runs.find_runs(words, bounds, direct) == [brute(split(t)) for t in texts]


@pytest.mark.parametrize("period", [64, 65, 66, 97, 98, 146, 147, 333, 500])
def test_every_period_is_found_at_its_scale(period):
    """The shortest run of a period, at all phases of the scale's windows, between other words."""
    rnd = random.Random(period)
    for _ in range(6):
        turn = [rnd.randint(0, 3) for _ in range(period - 1)] + [9]
        before = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 50))] + [7]
        words = np.array(before + turn * 4 + [8, 8] + turn * 3 + turn[: period - 1], np.int64)
        found = periodic_runs.find_runs(words, np.array([0, len(words)]))[0]
        assert (len(before), 4 * period, period) in found
        assert [r for r in found if r[2] > 64] == ([(len(before), 4 * period, period)] if period > 64 else [])


def test_long_runs_and_long_periods():
    words = np.concatenate([np.zeros(300_000, np.int64), np.tile(np.arange(20_000), 5), np.tile([1, 2], 50_000)])
    found = periodic_runs.find_runs(words, np.array([0, len(words)]))[0]
    # The last zero-run ends with the first word of the next stretch, and word 1 of the last one follows 19,999.
    assert found == [(0, 300_001, 1), (300_000, 100_000, 20_000), (400_000, 100_000, 2)]


def test_query_equals_its_contract_on_hard_rows(spark, documents, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, random_text(rnd)) for i in range(20, 220)] + [(None, "a b a b a b a b a b"), (None, None), (-7, "t " * 9)]
    rows += [r for r in ODD if r[0] != 10] + [(10, "word " * 1000), (300, "a b c d e f g " * 3000)]
    monkeypatch.setattr(queries, "table", lambda *_: documents(rows))
    found = queries.QUERIES["op13_periodic_runs"](spark, "").select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )
    small = [r for r in rows if len(r[1] or "") < 20_000]
    got = sorted(map(str, map(tuple, found.collect())))
    assert len(got) == len(rows)
    assert set(got) >= {str(facts(*r[:2])) for r in small}
    assert sorted(str(facts(*r[:2])) for r in small) == sorted(x for x in got if not x.startswith(("(9,", "(300,")))
    monkeypatch.setattr(queries, "table", lambda *_: documents(rows).limit(0))
    assert queries.QUERIES["op13_periodic_runs"](spark, "").count() == 0


def test_operator_gives_runs_and_texts(documents):
    found = periodic_runs.find(documents([(1, "so  la la la la la la fin"), (2, "a b")])).orderBy("doc_id").collect()
    assert [tuple(r) for r in found[0].runs] == [(1, 6, 1)] and found[0].collapsed == "so la fin"
    assert found[1].runs == [] and found[1].collapsed == "a b" and found[1].n_words == 2
