import hashlib
import random
import re
from collections import Counter

import pytest

from eventlens.llm import decontamination, queries
from tests.llm.conftest import ODD


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows(item):
    ws = words(item)
    return {tuple(ws[i : i + 10]) for i in range(len(ws) - 9)} if len(ws) >= 10 else {tuple(ws)} - {()}


def expected(docs, items):
    owners = [(str(i) if i is not None else "", w) for i, text in items for w in windows(text)]
    sizes = {len(w) for _, w in owners}
    by_window = {}
    for i, w in owners:
        by_window.setdefault(w, set()).add(i)
    out = []
    for doc_id, text in docs:
        ws = words(text)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(ws) - n + 1):
                own = by_window.get(tuple(ws[s : s + n]))
                if own:
                    hit.update(range(s, s + n))
                    found |= own
        ids = ",".join(sorted(found))
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return Counter(out)


def run(spark, documents, docs, items, monkeypatch):
    frames = {"documents": documents(docs), "benchmark": spark.createDataFrame(items or [(1, "x")], "item_id long, text string").limit(len(items))}
    monkeypatch.setattr(queries, "table", lambda _, __, name: frames[name])
    return Counter(map(tuple, queries.QUERIES["op12_decontamination"](spark, "").collect()))


def mixed(rnd, items, vocabulary):
    """Words of a small vocabulary, with whole items, parts of items around the window's length, and repeats."""
    out = []
    for _ in range(rnd.randint(0, 6)):
        kind = rnd.randint(0, 4)
        source = words(rnd.choice(items)[1]) or ["none"]
        if kind == 0:
            out += source
        elif kind == 1:
            at = rnd.randint(0, len(source))
            out += source[at : at + rnd.randint(7, 12)]
        elif kind == 2:
            out += [rnd.choice(vocabulary)] * rnd.randint(1, 90)
        else:
            out += [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))]
    return rnd.choice([" ", ", ", "\n"]).join(w.upper() if rnd.random() < 0.3 and w.isascii() else w for w in out)


@pytest.mark.parametrize("seed,letters,short", [(1, 3, True), (2, 40, False), (4, 1, True)])
def test_query_equals_brute_force(spark, documents, monkeypatch, seed, letters, short):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 3 else f"{i}" for i in range(letters)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(10, 30)))) for i in range(25)]
    if short:
        items += [(100 + n, " ".join(rnd.choice(vocabulary) for _ in range(n))) for n in (1, 2, 3, 5, 9, 10, 11)]
    items += [(3, items[4][1]), (None, items[5][1]), (60, None), (61, ""), (62, "?! ..."), (63, items[6][1]), (63, items[6][1])]
    docs = [(i, mixed(rnd, items[:25], vocabulary)) for i in range(100, 220)] + ODD
    docs += [(None, items[0][1]), (None, items[1][1]), (None, "clean"), (None, "clean"), (-5, items[2][1]), (-5, "clean too"), (-5, items[2][1])]
    assert run(spark, documents, docs, items, monkeypatch) == expected(docs, items)


def test_empty_tables(spark, documents, monkeypatch):
    docs = [(1, "a b c"), (2, None)]
    assert run(spark, documents, docs, [], monkeypatch) == expected(docs, [])
    assert run(spark, documents, docs, [(1, "...")], monkeypatch) == expected(docs, [])
    frames = {"documents": documents(docs).limit(0), "benchmark": spark.createDataFrame([(1, "a")], "item_id long, text string")}
    monkeypatch.setattr(queries, "table", lambda _, __, name: frames[name])
    assert queries.QUERIES["op12_decontamination"](spark, "").count() == 0


def test_a_very_long_hit_document(spark, documents, monkeypatch):
    item = " ".join(f"q{i}" for i in range(30))
    docs = [(1, f"{item} x " * 3000), (2, "a " * 50_000), (3, "b " + "a " * 9)]
    items = [(1, item), (2, "a " * 10)]
    assert run(spark, documents, docs, items, monkeypatch) == expected(docs, items)


def test_operator_gives_places_and_drops_rows(spark, documents):
    item = "one two three four five six seven eight nine ten eleven"
    docs = documents([(1, f"so {item.upper()} it is"), (2, "one two three"), (None, item), (None, "clean")])
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.find(docs.where("doc_id is not null"), items).collect()}
    assert [tuple(h) for h in found[1].hits] == [(1, 10), (2, 10)] and found[1]["items"] == ["7"]
    assert found[2].hits == [] and found[2]["items"] == []
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == {(2, "one two three"), (None, "clean")}
    assert decontamination.drop_contaminated(docs, items, 0.8).count() == 3
