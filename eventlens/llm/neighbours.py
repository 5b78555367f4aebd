"""Approximate nearest neighbours: an inverted multi-index.

Each half of a vector is quantised by its own centroids, so a cell is a pair of centroids. Centroids are
fitted on at most ``SAMPLE`` vectors; every vector is then put into its cell. A query goes through the pairs
in order of summed squared distance, with a heap over the two sorted lists of distances, until the cells it
passed hold a share ``SHARE`` of all vectors (``LEAST`` at least) or none are left; these are reranked by
their exact Euclidean distance. The share is what recall costs: vectors without any clusters, all about as
far from each other, are the hardest case, and there it still finds more than 0.9 of the true neighbours.

What the driver and the tasks hold whole is bounded by parameters: sample, centroids, one count per cell.
Of equal vectors only those with the ``k + 1`` smallest ids can be in a result (one may be the query), so the
others leave the index, cut inside the map tasks; a hot vector costs no more than any other. Cells with the
same first centroid are a block, cut by a hash of the id into parts of about ``PART`` vectors, and queries
are dealt to parts of about ``ASKED``; a task reranks one part of each and hands on ``k`` rows per query.

Cases: vectors that are null, zero, of a length other than the most frequent one, or hold a null, NaN or
infinite component take no part. A vector that repeats under one id is one candidate, an id with several
vectors is several; ties go to the smaller id. Rows with the query's id are never its result. With fewer
candidates than ``k`` all are found. No valid vector or query gives an empty result. Other columns may have
any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventlens.llm.texts import prepare
from eventlens.operators.ranked import first_ranked
from eventlens.session import settle

K = 10
SAMPLE = 8192
# Centroids per half, at most; fewer where the table has under PER_CENTROID vectors for each.
CENTROIDS = 128
PER_CENTROID = 4
SHARE = 0.5
LEAST = 1000
PART = 5000
ASKED = 2000
ROUNDS = 12

RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def centroids(points: np.ndarray, count: int, seed: int) -> np.ndarray:
    """k-means; a centroid that loses all points keeps its place."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(count, len(points)), replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        own = nearest(points, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        number = np.bincount(own, minlength=len(centres))
        filled = number > 0
        centres[filled] = total[filled] / number[filled, None]
    return centres


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1))


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squares(points, centres).argmin(axis=1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of first + second distance until they hold ``wanted`` vectors; empty ones are passed over."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, found, held = [(first[one[0]] + second[two[0]], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(one[i] * len(second) + two[j])
        if counts[cell]:
            found.append(cell)
            held += int(counts[cell])
        # Every pair is pushed once: along the second list always, along the first from its head only.
        if j + 1 < len(two):
            heapq.heappush(heap, (first[one[i]] + second[two[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (first[one[i + 1]] + second[two[0]], i + 1, 0))
    return found


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every row of ``queries``. Both have vec_id and embedding."""
    spark = vectors.sparkSession
    prepare(spark)

    def valid(df: DataFrame) -> DataFrame:
        cast = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return cast.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).dropDuplicates(["vec_id", "embedding"])

    sizes = valid(vectors).groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    size = sizes[0]["size"]
    rows = valid(vectors).where(F.size("embedding") == size)
    base = settle(first_ranked(rows.withColumn("same", F.xxhash64("embedding")), ["same", "embedding"], ["vec_id"], k + 1).drop("same"))
    asked = settle(valid(queries).where(F.size("embedding") == size))
    total, groups = base.count(), max(1, -(-asked.count() // ASKED))
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    points = np.array([r.embedding for r in sample])
    half = (size + 1) // 2
    number = int(np.clip(total // PER_CENTROID, 1, CENTROIDS))
    one = centroids(points[:, :half], number, 1)
    two = centroids(points[:, half:], number, 2) if size > 1 else np.zeros((1, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"))
                cells = [nearest(x[:, :half], one), nearest(x[:, half:], two)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c.astype(np.int32)) for c in cells]], names=["vec_id", "embedding", "block", "cell"])

    index = settle(base.mapInArrow(place, "vec_id long, embedding array<double>, block int, cell int"))
    counts = np.zeros((len(one), len(two)), np.int64)
    for row in index.groupBy("block", "cell").count().collect():
        counts[row.block, row.cell] = row["count"]
    parts = np.maximum(1, -(-counts.sum(axis=1) // PART)).tolist()
    wanted = max(int(np.ceil(share * total)), least, k + 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, list[int]]] = []
            x = _matrix(batch.column("embedding")) if batch.num_rows else np.empty((0, size))
            a, b = squares(x[:, :half], one), squares(x[:, half:], two)
            for i in range(len(x)):
                cells = np.array(traverse(a[i], b[i], counts.reshape(-1), wanted), np.int64)
                for block in np.unique(cells // len(two)).tolist():
                    own = (cells[cells // len(two) == block] % len(two)).tolist()
                    out += [(i, block, part, own) for part in range(parts[block])]
            at = pa.array([o[0] for o in out], pa.int64())
            columns = [pa.array([o[n] for o in out], t) for n, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), batch.column("embedding").take(at), *columns], names=["query_id", "query", "block", "part", "cells"]
            )

    def rerank(key: tuple, have: pa.Table, ask: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if have.num_rows and ask.num_rows:
            x, ids = _matrix(have.column("embedding").combine_chunks()), have.column("vec_id").to_numpy()
            cell = have.column("cell").to_numpy()
            for query_id, query, cells in zip(
                ask.column("query_id").to_pylist(), _matrix(ask.column("query").combine_chunks()), ask.column("cells").to_pylist(), strict=True
            ):
                passed = np.zeros(len(two), bool)
                passed[cells] = True
                own = np.flatnonzero(passed[cell] & (ids != query_id))
                score = np.sqrt(((x[own] - query) ** 2).sum(axis=1))
                best = np.lexsort((ids[own], score))[:k]
                found += zip([query_id] * len(best), ids[own][best].tolist(), score[best].tolist(), strict=True)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    probes = asked.mapInArrow(probe, "query_id long, query array<double>, block int, part int, cells array<int>").withColumn("group", group)
    part = F.pmod(F.xxhash64("vec_id"), F.get(F.array(*[F.lit(p) for p in parts]), F.col("block"))).cast("int")
    stored = index.withColumn("part", part).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    key = ["block", "part", "group"]
    near = stored.groupBy(*key).cogroup(probes.groupBy(*key)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    best = first_ranked(near, ["query_id"], ["score", "vec_id"], k)
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
