import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventlens.llm import components, exact_dedup, near_dedup, suffix_dedup
from tests.llm.conftest import ODD


def words(text):
    lowered = re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[a-z0-9\x80-\xff]+", lowered)


def plain_classes(rows, threshold=0.8):
    """Classes by comparing all pairs of texts that share a shingle."""
    rows = list(dict(rows).items())
    sets = []
    for _, text in rows:
        own = words(text)
        sets.append(Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else Counter())
    df = Counter(s for own in sets for s in own)
    n = len(rows)
    weight = {s: 1 + math.log((1 + n) / (1 + c)) / math.log(1 + n) for s, c in df.items()}
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(n):
        for y in range(x):
            if not sets[x] and not sets[y]:
                same = (rows[x][1] or "") == (rows[y][1] or "")
            else:
                low = sum(min(c, sets[y][s]) * weight[s] for s, c in sets[x].items())
                high = sum(max(sets[x][s], sets[y][s]) * weight[s] for s in sets[x].keys() | sets[y].keys())
                same = low >= threshold * high
            if same:
                a, b = sorted((root(x), root(y)), key=lambda k: rows[k][0])
                parent[b] = a
    groups = defaultdict(list)
    for k in range(n):
        groups[root(k)].append(rows[k][0])
    return {i: min(g) for g in groups.values() for i in g}


def planted(seed=2, groups=25):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(6, 200))] + (passage if rnd.random() < 0.5 else [])
        for _ in range(rnd.randint(1, 6)):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 8])):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((100 + len(rows), rnd.choice([" ", ", ", "\n"]).join(text)))
    return rows


def test_classes_equal_those_of_all_pairs(documents):
    rows = planted() + [(i, t) for i, t in ODD if i != 12] + [(20, "same text again"), (21, "Same, text AGAIN!")]
    want = plain_classes(rows)
    found = near_dedup.classes(documents(rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in found) and len(found) == len(rows)


def test_a_hot_group_of_near_copies_is_one_class(documents):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 2000)}" for _ in range(300)]
    rows = []
    for i in range(120):
        text = list(base)
        text[rnd.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(text)))
    docs = documents(rows + [(500, "something else")])
    assert {r.class_id for r in near_dedup.classes(docs).collect()} == {0, 500}
    kept = near_dedup.drop_near_copies(docs)
    assert {r.doc_id for r in kept.collect()} == {0, 500} and kept.columns == docs.columns


def test_near_dedup_of_odd_tables(documents):
    found = Counter((r.doc_id, r.class_id) for r in near_dedup.classes(documents(ODD)).collect())
    assert found == Counter({(1, 1): 1, (2, 1): 1, (3, 1): 1, (4, 4): 1, (5, 5): 1, (6, 5): 1, (7, 7): 1, (8, 8): 1, (9, 9): 1, (10, 10): 1, (11, 11): 1,
                             (12, 12): 2, (13, 13): 1})
    assert near_dedup.classes(documents(ODD).limit(0)).count() == 0
    assert Counter(r.class_id for r in near_dedup.classes(documents([(None, "a b c"), (4, "a b c"), (None, "x")])).collect()) == {4: 2, None: 1}


def test_samples_agree_as_often_as_weights_are_similar():
    rng = np.random.default_rng(1)
    ids = rng.choice(1 << 44, 400, replace=False).astype(np.uint64)
    one, two = np.sort(ids[:300]), np.sort(ids[100:])
    weight = {int(i): w for i, w in zip(ids, rng.uniform(1, 3, 400))}
    a, b = np.array([weight[int(i)] for i in one]), np.array([weight[int(i)] * 1.2 for i in two])
    drawn = near_dedup.samples(np.concatenate((one, two)), np.concatenate((a, b)), np.array([0, 300, 600]), 3000)
    true = near_dedup.similarity((one, a), (two, b))
    assert abs((drawn[0] == drawn[1]).mean() - true) < 0.04


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rnd = random.Random(3)
    pairs = {"chain": [(i, i + 1) for i in range(60)], "star": [(50, i) for i in range(40)], "random": [(rnd.randint(0, 99), rnd.randint(0, 99)) for _ in range(60)]}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs[shape]:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {x: root(x) for a, b in pairs[shape] if a != b for x in (a, b)}
    found = components.components(spark.createDataFrame(pairs[shape], "a long, b long")).collect()
    assert {r.node: r.component for r in found} == want and len(found) == len(want)


def plain_repeats(rows, length=suffix_dedup.LENGTH):
    seen, out = {}, {}
    for i, text in sorted(dict(rows).items(), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if seen.setdefault(data[s : s + length], (i, s)) != (i, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, kept)
    return out


def repetitive(seed, count=150):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcd é") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(count):
        text = ""
        for _ in range(rnd.randint(0, 5)):
            kind, at = rnd.random(), rnd.randint(0, 300)
            if kind < 0.7:
                text += rnd.choice(base)[at : at + rnd.randint(60, 200)]
            elif kind < 0.8:
                text += "ab" * rnd.randint(0, 150)
            else:
                text += "".join(rnd.choice("abcde\u0000 ") for _ in range(rnd.randint(0, 200)))
        rows.append((100 + i, text))
    return rows


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_repeats_are_those_of_all_windows(documents, hot):
    rows = repetitive(7) + [(i, t[:3000] if t else t) for i, t in ODD] + [(None, "q" * 120), (30, "q" * 120 + "z")]
    want = plain_repeats(rows)
    found = suffix_dedup.remove_repeats(documents(rows, 5), hot=hot).collect()
    assert len(found) == len(rows)
    for r in found:
        size, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, removed, spans, hashlib.sha256(kept).hexdigest()), r.doc_id


def test_long_texts_are_cut_into_parts_without_loss(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 500)
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, base), (2, "x" + base[700:2500] + "y" + base[100:900])]
    parts = [b for b in suffix_dedup._runs_of(iter([pa_rows(rows)]))]
    total = sum(b.num_rows for b in parts)
    assert total > 30
    want = plain_repeats(rows)
    monkeypatch.undo()
    found = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(documents(rows)).collect()}
    assert found == {i: w[1] for i, w in want.items()}


def pa_rows(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "text": [r[1] for r in rows]})


def test_texts_without_repeats_keep_all_columns(documents):
    rows = repetitive(8, 60) + [(1, None), (2, "")]
    docs = documents(rows)
    found = suffix_dedup.without_repeats(docs)
    assert found.dtypes == docs.dtypes
    want = plain_repeats(rows)
    before = {r.doc_id: r for r in docs.collect()}
    for r in found.collect():
        text = None if before[r.doc_id].text is None else want[r.doc_id][3].decode("utf-8", "ignore")
        assert r.text == text and r.n_chars == len(text or "")
        assert r.asDict() | {"text": 0, "n_chars": 0} == before[r.doc_id].asDict() | {"text": 0, "n_chars": 0}
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_merged_transforms_order_all_suffixes():
    rnd = random.Random(4)
    shards, texts = [], []
    for _ in range(3):
        own = [[rnd.choice([1, 2]) for _ in range(rnd.randint(0, 12))] for _ in range(8)]
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in own])))
        symbols = np.array([x for t in own for x in (*t, 0)], np.uint16)
        table, order = suffix_dedup.transform(symbols, bounds)
        string = np.searchsorted(bounds, order, side="right") - 1
        shards.append((table, len(own)))
        texts += [tuple(own[s][p - bounds[s] :]) for s, p in zip(string, order)]
    source, common = suffix_dedup.merge([t for t, _ in shards], [n for _, n in shards], 20)
    merged = [texts[i] for i in source]
    assert sorted(source.tolist()) == list(range(len(texts))) and merged == sorted(merged)
    for a, b, c in zip(merged, merged[1:], common[1:]):
        shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert c == shared


def within_keys(spark, rows, groups=()):
    """Links that _within_keys finds where all documents share one key."""
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [max(1, len(t.split()) - 4) for _, t in rows]
    kinds = "doc_id long, size long, band int, key long, hub long, next long, total long"
    members = spark.createDataFrame([(i, n, 0, 1, rows[0][0], i, sum(sizes)) for (i, _), n in zip(rows, sizes)], kinds)
    placed = spark.createDataFrame(list(groups), "node long, component long")
    texts = texts.join(signed(texts).select("doc_id", "df"), "doc_id")
    return {frozenset((r.a, r.b)) for r in near_dedup._within_keys(members, texts, placed, len(rows), 0.8).collect()}


def signed(texts):
    blocked, blocks, documents = near_dedup._blocks(texts)
    return near_dedup._signed(blocked, near_dedup._frequencies(blocked, blocks), documents)


def twins(count, size=40, seed=11):
    rnd = random.Random(seed)
    rows = []
    for k in range(count):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(size)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base, f"new{k}"]))]
    return rows


def test_a_key_of_many_shingles_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP", 150)
    assert within_keys(spark, twins(20)) == {frozenset((2 * k, 2 * k + 1)) for k in range(20)}


def test_no_task_gets_more_documents_than_two_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "DOCUMENTS", 10)
    members = spark.createDataFrame([(i, 20, 0, 1, 0) for i in range(200)], "doc_id long, size long, band int, key long, hub long")
    joined = spark.createDataFrame([(i, 0) for i in range(150)], "node long, component long")
    tasks = defaultdict(list)
    for r in near_dedup._meetings(members, joined).selectExpr("*", "inline(met)").collect():
        tasks[r.i, r.j].append(r)
    assert max(map(len, tasks.values())) <= 50
    met = {frozenset((a.doc_id, b.doc_id)) for (i, j), rows in tasks.items() for a in rows if a.x == i for b in rows if b.y == j if a.own != b.own}
    assert met == {frozenset((a, b)) for a in range(200) for b in range(150, 200) if a != b}
    assert not any(a.x == i for (i, j), rows in tasks.items() for a in rows if a.own == 0)


def test_document_frequencies_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 500)
    rows = twins(30) + [(100, None), (101, "a b")]
    found = signed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    sets = {i: Counter(tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)) or Counter([tuple(words(t))] if words(t) else []) for i, t in rows}
    df = Counter(x for own in sets.values() for x in own)
    for r in found:
        assert sorted(near_dedup._unpacked([r.df]).tolist()) == sorted(df[x] for x in sets[r.doc_id])


def passages(seed):
    """Texts without common parts: P, A and B, and T with one of many words changed."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    p, a, b = (" ".join(word() for _ in range(60)) for _ in range(3))
    words = [word() for _ in range(80)]
    changed = [*words[:40], "changed", *words[41:]]
    return p, a, b, " ".join(words), " ".join(changed)


def test_spans_belong_to_one_text_of_an_id(documents):
    p, a, b, *_ = passages(1)
    for one, two in ((5, 5), (None, None), (None, 7)):
        rows = [(1, p), (one, a + p), (two, b), (two, b)]
        found = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(documents(rows)).collect())
        # Rows without an id come first, so there the first passage stays and the one of id 1 goes.
        first = one is None
        want = Counter([(1, len(p), len(p) if first else 0), (one, len(a + p), 0 if first else len(p)), (two, len(b), 0), (two, len(b), 0)])
        assert found == want
    kept = suffix_dedup.without_repeats(documents([(1, p), (5, a + p), (5, b), (None, p), (None, b)])).collect()
    # Of the two rows without an id both come first, and so theirs stay.
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, p), (None, b), (1, ""), (5, a), (5, "")])


def test_near_copies_without_ids_and_of_repeated_ids(documents):
    *_, b, text, changed = passages(2)
    found = near_dedup.classes(documents([(None, text), (4, changed), (9, b)])).collect()
    assert Counter((r.doc_id, r.class_id, r.kept) for r in found) == Counter([(4, 4, True), (None, 4, False), (9, 9, True)])
    rows = [(3, text), (4, changed), (4, b), (4, b), (None, b + " and more"), (None, None), (None, "")]
    found = Counter((r.doc_id, r.class_id, r.kept) for r in near_dedup.classes(documents(rows)).collect())
    # The other text of id 4 is a class of its own, with the near copy that has no id; the empty texts are one row's.
    assert found == Counter([(3, 3, True), (4, 3, False), (4, 4, True), (4, 4, True), (None, 4, False), (None, None, True), (None, None, True)])
    kept = near_dedup.drop_near_copies(documents(rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(3, text), (4, b), (4, b), (None, None), (None, "")])


def test_exact_copies_of_an_id_with_two_texts(documents):
    kept = exact_dedup.drop_exact_copies(documents([(5, "copy"), (9, "Copy"), (5, "own"), (None, "own"), (None, "x")])).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(9, "Copy"), (5, "own"), (None, "x")])
