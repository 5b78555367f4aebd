import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eventlens.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, lo long, digest string, carried string, leaves int, part string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(level):
    """The top of a tree, and for every leaf the siblings left and right of its way up."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for leaf_, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            paths[leaf_].append((run[: i % 3], run[i % 3 + 1 :]))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def expected(rows):
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        cut = leaf(doc_id, source, lang, n_chars, text.replace("\n", "") if text is not None else None) if tampered else own
        by_source[source].append(((doc_id is not None, doc_id or 0, own), doc_id, own, cut))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        leaves = sorted(by_source[source], key=lambda r: r[0])
        trees.append((leaves, *climb([r[2] for r in leaves])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (leaves, subroot, paths), top in zip(trees, tops, strict=True):
        for (_, doc_id, own, cut), path in zip(leaves, paths, strict=True):
            folded = cut
            for left, right in path + top:
                folded = sha("".join([*left, folded, *right]))
            proof = sha("".join("".join(left + right) for left, right in path + top))
            out.append((doc_id, own, subroot, root, proof, folded, folded == root))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "d", "c", 2, "p") for r in rows], SCHEMA).repartition(3)


def run(spark, rows, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: frame(spark, rows))
    return Counter(map(tuple, queries.QUERIES["op11_merkle_manifest"](spark, "").collect()))


@pytest.mark.parametrize("sources", [1, 4, 11])
def test_query_equals_climbing_every_tree(spark, monkeypatch, sources):
    rnd = random.Random(sources)
    names = [None, "é", "z", "", "Z", *[f"s{i}" for i in range(20)]][:sources]
    # The last source is hot.
    rows = [
        (i, rnd.choice([None, "", "a\nb\n", "plain", "漢字\n" * 3]), rnd.choice([None, "en"]), rnd.choice(names + [names[-1]] * len(names)), rnd.choice([None, i]))
        for i in rnd.sample(range(-50, 10_000), 150)
    ]
    rows += [(None, "x\n", "en", names[0], 2), (None, None, None, names[0], None), (7, "x\ny", "en", names[0], 3), (7, "other", "en", names[0], 3)]
    rows += [(8, "same\nrow", "de", names[0], 1)] * 5 + [(9, "long\n" * 100_000, "en", names[0], 500_000)]
    assert run(spark, rows, monkeypatch) == Counter(expected(rows))


@pytest.mark.parametrize("count", [0, 1, 3, 10])
def test_single_trees_of_every_shape(spark, monkeypatch, count):
    rows = [(i, f"t\n{i}", "en", "s", i) for i in range(count)]
    assert run(spark, rows, monkeypatch) == Counter(expected(rows) if rows else [])


def test_lone_leaves_are_their_subroots(spark, monkeypatch):
    rows = [(i, "t", "en", f"s{i:03}", 1) for i in range(30)]
    assert run(spark, rows, monkeypatch) == Counter(expected(rows))


def test_paths_prove_any_later_reading_of_a_row(spark):
    """The general interface: a manifest is kept, and rows that are read again are folded with its paths."""
    rows = [(i, f"text {i}", "en", f"s{i % 4}", i) for i in range(40)]
    kept = merkle.manifest(frame(spark, rows))
    again = frame(spark, [(i, t if i != 17 else "changed", *rest) for i, t, *rest in rows])
    now = again.select("doc_id", merkle.leaf([F.col(c) for c in merkle.COLUMNS]).alias("now"))
    wrong = kept.join(now, "doc_id").where(merkle.fold(F.col("now"), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in wrong.collect()] == [17]
