import zlib

import numpy as np
import pytest

from eventlens.llm import language, quality
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def fold(i, divisor):
    return zlib.crc32(str(i).encode()) % divisor


def test_blocks_cover_texts_and_chunks_overlap():
    texts = [b"", b"ab", bytes(range(1, 250)) * 3]
    flat, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    block, bounds = quality.blocks(flat, offsets)
    assert bounds.tolist() == [0, 1, 2, 5]
    assert not block[0].any() and block[1][:3].tolist() == [98, 99, 0]
    back = np.concatenate([b[: quality.BLOCK] for b in block[2:]])
    assert (back[: len(texts[2])] == np.frombuffer(texts[2], np.uint8).astype(int) + 1).all() and not back[len(texts[2]) :].any()


def plain_score(net, text):
    """The network by its definition: chunk by chunk, place by place."""
    values = [b + 1 for b in text]
    count = max(1, -(-len(values) // quality.BLOCK))
    values += [0] * (count * quality.BLOCK + quality.WIDTH - len(values))
    logits = []
    for first in range(max(1, count - 1)):
        places = range(first * quality.BLOCK, min(first + 2, count) * quality.BLOCK)
        pool = np.max([sum(net["filters"][k][values[p + k]] for k in range(quality.WIDTH)) for p in places], axis=0)
        hidden = np.maximum(np.maximum(pool + net["shift"], 0) @ net["inner"] + net["inner_shift"], 0)
        logits.append(float(hidden @ net["outer"] + net["outer_shift"]))
    return 1 / (1 + np.exp(-np.mean(logits)))


def test_scores_follow_the_definition():
    good = [np.random.default_rng(i).choice(list(b"etaoin shrdlu."), 300).astype(np.uint8).tobytes() for i in range(30)]
    bad = [np.random.default_rng(i).choice(list(b"#$%&*"), 300).astype(np.uint8).tobytes() for i in range(30)]
    net = quality.fit({0: bad, 1: good})
    texts = [b"", b"short", good[0] * 5, bad[0] + good[1], bytes(700)]
    flat, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    found = quality.scores(net, flat, offsets)
    assert np.allclose(found, [plain_score(net, t) for t in texts], atol=1e-5)
    one = quality.scores(net, *[np.frombuffer(good[3], np.uint8), np.array([0, 300])])
    other = quality.scores(net, *[np.frombuffer(bad[3], np.uint8), np.array([0, 300])])
    assert one > 0.8 and other < 0.2


def test_quality_is_learned_and_held_out_rows_agree(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = {r.doc_id: r for r in quality.score(docs, quality.learn(docs, labels)).collect()}
    assert len(found) == docs.count()
    marked = [(found[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in found]
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    held = [(r, q) for r, q in marked if r.held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.9


def test_quality_of_odd_rows_and_one_sided_labels(documents, spark):
    docs = documents(ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    good = spark.createDataFrame([(i, 1) for i in range(1, 14)] + [(99, 0), (4, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.learn(docs, none)).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, quality.learn(docs, good)).collect()} == {1.0}
    net = quality.fit({0: [b"#" * 50], 1: [b"some words here"]})
    assert quality.score(docs, net).count() == len(ODD)
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns
    assert quality.score(docs.limit(0), net).count() == 0


def test_language_is_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in language.predict(docs, language.learn(docs)).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert all(found[r.doc_id].held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    held = [found[r.doc_id].lang_pred == r.lang for r in rows if fold(r.doc_id, 4) == 2]
    assert len(held) > 100 and np.mean(held) > 0.95


def test_margins_are_the_machines_answers():
    texts = [b"der die das", b"", b"the of and", b"x", b"y" * 5000]
    model = language.fit({"en": [b"the of and it is"] * 5, "de": [b"der die und das ist"] * 5, "fr": [b"le la les et est"] * 5, "xx": [b"zzz qqq"] * 5})
    assert model.families == ["germanic", "romance", "xx"]
    flat, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    for step in (7, 1 << 18):
        answers = language.margins(model, flat, offsets, step)
        assert np.allclose(answers, language.shares(texts) / language.SCALE @ model.weights + model.shifts, atol=1e-4)
    names, score = language.decide(model, answers)
    assert names[0] == "de" and names[2] == "en" and ((score >= 0) & (score <= 1)).all()


def test_language_of_odd_rows(documents):
    rows = [(*r, lang) for r, lang in zip(ODD, ["en", None, "de"] * 5, strict=False)]
    docs = documents(rows)
    found = language.predict(docs, language.learn(docs)).collect()
    lettered = {4, 5, 6, 9, 10, 11, 12, 13}
    assert len(found) == len(ODD)
    assert all((r.lang_pred == "und") == (r.doc_id not in lettered) and 0 <= r.score <= 1 for r in found)
    blank = documents([(i, t, None) for i, t in ODD])
    assert {(r.lang_pred, r.score) for r in language.predict(blank, language.learn(blank)).collect()} == {("und", 0.0)}
    single = documents([(i, t, "en") for i, t in ODD])
    assert {(r.lang_pred, r.score) for r in language.predict(single, language.learn(single)).collect()} == {("und", 0.0), ("en", 1.0)}
    assert language.predict(docs.limit(0), language.learn(docs.limit(0))).count() == 0


@pytest.mark.parametrize("rows", [1, 5])
def test_samples_are_bounded(documents, rows):
    from eventlens.llm.samples import CHUNK, PER_TEXT, labelled_chunks

    docs = documents([(i, "abc " * 1000) for i in range(40)] + [(3, "again")] * 10)
    labels = docs.select("doc_id").distinct().selectExpr("doc_id", "cast(doc_id % 2 as int) AS label")
    found = labelled_chunks(docs.select("doc_id", "text"), labels, rows)
    assert set(found) == {0, 1}
    assert all(0 < len(c) <= PER_TEXT * rows and all(len(x) <= CHUNK for x in c) for c in found.values())


def test_quality_finds_both_labels(spark):
    """Held-out rows of a table with a few hundred bad labelled texts: most are bad or good by name, so each label counts by itself."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score(docs, quality.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    for label, least in ((0, 0.88), (1, 0.98)):
        assert np.mean([r.predicted == label for r in found if r.quality == label]) > least


def test_rare_languages_are_learned(spark):
    """More languages than rows could be shared evenly among; each has an alphabet of its own."""
    rows = [(60 * lang + i, "".join(chr(0x4E00 + 40 * lang + (7 * i + j) % 40) for j in range(60)), f"l{lang:03}") for lang in range(110) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language.predict(docs, language.learn(docs)).collect()}
    assert len(set(found.values())) == 110
    assert np.mean([found[i] == lang for i, _, lang in rows]) > 0.95
