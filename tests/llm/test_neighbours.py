import math
import random

import numpy as np

from eventlens.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, query_id int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x for x in v)


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        best = sorted((math.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(v, w))), i) for i, w in rows if i != q)
        out[q] = [(i, s) for s, i in best[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 0, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_all_cells_give_the_exact_answer_with_ties_and_odd_vectors(spark):
    rnd = random.Random(1)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(5)]) for i in range(300)] + [(1000 + i, [1.0, 0, 0, 0, 0]) for i in range(50)]
    odd = [(2000, None), (2001, [0.0] * 5), (2002, [math.nan, 1, 1, 1, 1]), (2003, [None, 1, 1, 1, 1]), (2004, [math.inf, 1, 1, 1, 1]),
           (2005, [1.0, 2.0]), (None, [1.0] * 5)]
    good = [(i, [np.float32(x) for x in v]) for i, v in rows if usable(v)]
    df = frame(spark, rows + odd + rows[:5])
    queries = df.where("vec_id % 50 = 0 or vec_id is null")
    got = found(neighbours.search(df, queries, share=1.0))
    assert got == brute(good, [(i, v) for i, v in good if i % 50 == 0], 10)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = found(neighbours.search(df, df.where("vec_id % 20 = 0"), least=1))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 10 * len(want)


def test_few_or_no_rows(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(4)]
    df = frame(spark, rows)
    assert {q: [i for i, _ in v] for q, v in found(neighbours.search(df, df.where("vec_id = 0"))).items()} == {0: [1, 2, 3]}
    assert neighbours.search(df.limit(0), df).count() == 0
    assert neighbours.search(df, df.limit(0)).count() == 0
    assert found(neighbours.search(frame(spark, [(1, [2.0])]), frame(spark, [(7, [3.0])]))) == {7: [(1, 1.0)]}


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    first, second = rng.random(7), rng.random(5)
    counts = rng.integers(0, 3, 35)
    order = neighbours.traverse(first, second, counts, 10**9)
    sums = [first[c // 5] + second[c % 5] for c in order]
    assert sums == sorted(sums) and sorted(order) == np.flatnonzero(counts).tolist()
    some = neighbours.traverse(first, second, counts, 9)
    assert some == order[: len(some)] and counts[some].sum() >= 9 > counts[some[:-1]].sum()
