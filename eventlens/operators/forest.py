"""Isolation forest (Liu, Ting, Zhou 2008) trained and applied on Spark.

Training needs ``trees * 256`` rows whatever the table's size: hashes of the row key pick them, each
tree is grown in its own task, and the forest is a table of at most ``trees * 511`` nodes.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from eventlens.operators.ranked import first_ranked
from eventlens.session import settle

# Tasks get the masks with their code, so that workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the model.
TREES = 100
SAMPLE = 256
SEED = 42
CONTAMINATION = 0.1
EULER = 0.5772156649

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def average_path(m: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree over ``m`` rows."""
    if m <= 1:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (math.log(m - 1) + EULER) - 2.0 * (m - 1) / m


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees (a small pandas table) and the sample size they were grown on."""

    features: tuple[str, ...]
    nodes: pd.DataFrame
    sample: int


def pick_counts(trees: int, share: float) -> list[float]:
    """For k = 0, 1, ..., trees - 1 the chance that at most k trees pick a row which each picks with this chance."""
    if share >= 1:
        return [0.0] * trees
    chances, at_most = [], 0.0
    for k in range(trees):
        ways = math.lgamma(trees + 1) - math.lgamma(k + 1) - math.lgamma(trees - k + 1)
        at_most += math.exp(ways + k * math.log(share) + (trees - k) * math.log1p(-share))
        chances.append(min(at_most, 1.0))
    return chances


def sample_rows(
    df: DataFrame, key: Sequence[str], features: Sequence[str], rows: int, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """(key, tree, pick, x): ``sample`` rows per tree, or all if there are fewer, drawn for each tree by itself.

    ``key`` must be unique. One hash of a row is a number in [0, 1]; by the inverse of the binomial distribution
    it says how many trees pick the row, which is none for nearly all rows of a large table. Only rows
    that are picked draw the numbers of their trees. About ``2 * trees * sample`` picks leave the scan of any table, and of
    these each tree takes the lowest by a second hash. The rule is the same for every number of rows.
    """
    at_most = pick_counts(trees, min(1.0, (2.0 * sample + 50) / rows))
    number = F.xxhash64(F.lit(seed), *key) / F.lit(2.0**64) + F.lit(0.5)
    picked = df.where(number >= F.lit(at_most[0]))
    count = F.size(F.filter(F.array(*[F.lit(c) for c in at_most]), lambda c: F.col("number") >= c))
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64(F.lit(seed), t, *key).alias("h"), t.alias("t"))))
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    chosen = picked.select(*key, x.alias("x"), number.alias("number"), drawn.alias("drawn"))
    chosen = chosen.select(*key, "x", F.explode(F.slice("drawn", F.lit(1), count)["t"]).alias("tree"))
    ranked = chosen.withColumn("pick", F.xxhash64(F.lit(seed + 1), "tree", *key))
    return first_ranked(ranked, ["tree"], ["pick", *key], sample)


def require_unique(samples: DataFrame, key: Sequence[str], trees: int, sample: int) -> None:
    """Raise if a key repeats among the drawn rows, or draws fall short.

    Equal keys are drawn together, so among ``trees * sample`` picks a share of repeated keys in the table
    shows up as nearly the same share: 1 in 1,000 repeats escapes with a chance below 1 in 10,000 of the default.
    A table no larger than a sample is checked whole.
    """
    repeated = samples.groupBy("tree", *key).agg(F.count(F.lit(1)).alias("rows"))
    rows, most = repeated.agg(F.sum("rows"), F.max("rows")).first()
    if most != 1 or rows != trees * sample:
        raise ValueError(f"the key {list(key)} is not unique")


def grow(samples: DataFrame, sample: int, seed: int = SEED) -> DataFrame:
    """The node table: one tree per task from its few sampled rows."""
    limit = max(1, math.ceil(math.log2(max(sample, 2))))
    depth_of = {m: average_path(m) for m in range(sample + 1)}

    def grow_one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = np.vstack(pdf.sort_values("pick", kind="stable")["x"].to_list())
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = []
        todo = [(rows, 0, -1, 0)]
        while todo:
            part, depth, parent, side = todo.pop()
            number = len(nodes)
            if parent >= 0:
                nodes[parent][4 + side] = number
            low, high = part.min(axis=0), part.max(axis=0)
            varied = np.flatnonzero(high > low)
            if depth >= limit or len(part) <= 1 or not len(varied):
                nodes.append([tree, number, -1, 0.0, -1, -1, depth + depth_of[len(part)]])
                continue
            feature = int(rng.choice(varied))
            cut = float(rng.uniform(low[feature], high[feature]))
            # The cut must leave a row on both sides.
            cut = max(cut, float(np.nextafter(low[feature], high[feature])))
            goes_left = part[:, feature] < cut
            nodes.append([tree, number, feature, cut, -1, -1, 0.0])
            todo.append((part[~goes_left], depth + 1, number, 1))
            todo.append((part[goes_left], depth + 1, number, 0))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    return samples.groupBy("tree").applyInPandas(grow_one, NODE_SCHEMA)


def fit_forest(
    df: DataFrame, key: Sequence[str], features: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED
) -> Forest:
    """Train on a table of scaled features; brings only the node table to the driver."""
    rows = df.count()
    if rows == 0:
        raise ValueError("cannot train on an empty table")
    per_tree = min(sample, rows)
    samples = settle(sample_rows(df, key, features, rows, trees, per_tree, seed))
    require_unique(samples, key, trees, per_tree)
    nodes = grow(samples, per_tree, seed)
    table = nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    return Forest(tuple(features), table, per_tree)


# Trees whose masks are looked up together.
TREE_GROUP = 25


def _leaves(nodes: pd.DataFrame) -> tuple[list[tuple[int, float, int, int]], list[float]]:
    """Of one tree: its cuts (feature, threshold, first and end of the leaves to their left), and the paths of its leaves from left to right."""
    rows = {int(r.node): r for r in nodes.itertuples()}
    cuts, paths = [], []

    def visit(number: int) -> None:
        row = rows[number]
        if row.feature < 0:
            paths.append(float(row.path))
            return
        first = len(paths)
        visit(int(row.left))
        cuts.append((int(row.feature), float(row.threshold), first, len(paths)))
        visit(int(row.right))

    visit(0)
    return cuts, paths


@dataclass(frozen=True)
class LeafMasks:
    """Some trees as bit masks, one bit per leaf from left to right.

    A row that is not below a cut cannot end in the leaves to the cut's left. ``masks[f][j]`` has, for every
    tree, the leaves that the first j of all trees' sorted cuts on feature f leave; a row's leaf is the first one that all
    features leave. No node is walked.
    """

    cuts: list[np.ndarray]
    masks: list[np.ndarray]
    paths: np.ndarray

    @classmethod
    def of(cls, trees: Sequence[pd.DataFrame], features: int) -> LeafMasks:
        parts = [_leaves(t) for t in trees]
        most = max(len(paths) for _, paths in parts)
        words = -(-most // 64)
        at: list[list[tuple[float, int, int, int]]] = [[] for _ in range(features)]
        for tree, (cuts, _) in enumerate(parts):
            for feature, threshold, first, end in cuts:
                at[feature].append((threshold, tree, first, end))
        masks = []
        for own in at:
            own.sort()
            left = np.full((len(own) + 1, len(parts), words), np.uint64(2**64 - 1))
            for j, (_, tree, first, end) in enumerate(own, 1):
                bits = ~(((1 << (end - first)) - 1) << first)
                left[j, tree] = [np.uint64(bits >> (64 * w) & (2**64 - 1)) for w in range(words)]
            masks.append(np.bitwise_and.accumulate(left, axis=0).reshape(len(own) + 1, -1))
        paths = np.zeros((len(parts), most))
        for tree, (_, own) in enumerate(parts):
            paths[tree, : len(own)] = own
        return cls([np.array([c[0] for c in own]) for own in at], masks, paths)

    def path_lengths(self, block: np.ndarray) -> np.ndarray:
        """Path lengths of every row in these trees, one column per tree."""
        left = None
        for feature, (cuts, masks) in enumerate(zip(self.cuts, self.masks, strict=True)):
            if len(cuts):
                # NaN is below no cut; it is sorted behind all of them.
                own = masks[np.searchsorted(cuts, block[:, feature], side="right")]
                left = own if left is None else np.bitwise_and(left, own, out=left)
        trees = len(self.paths)
        if left is None:
            return np.broadcast_to(self.paths[:, 0], (len(block), trees))
        left = left.reshape(len(block), trees, -1)
        word = (left != 0).argmax(axis=2)
        bits = np.take_along_axis(left, word[:, :, None], axis=2)[:, :, 0]
        # The lowest set bit is a power of two, which a double holds exactly.
        lowest = np.frexp((bits & (~bits + np.uint64(1))).astype(np.float64))[1] - 1
        return self.paths[np.arange(trees), word * 64 + lowest]


def mean_path(forest: Forest) -> Column:
    """Mean path length of each row over all trees, as one Arrow-batched expression."""
    trees = [own for _, own in forest.nodes.groupby("tree")]
    groups = [LeafMasks.of(trees[i : i + TREE_GROUP], len(forest.features)) for i in range(0, len(trees), TREE_GROUP)]

    @F.pandas_udf("double")
    def look_up(x: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        for first in range(0, len(x), 1024):
            block = np.vstack(x.iloc[first : first + 1024].to_list())
            out[first : first + len(block)] = np.hstack([g.path_lengths(block) for g in groups]).mean(axis=1)
        return pd.Series(out)

    return look_up(F.array(*[F.col(f"`{f}`").cast("double") for f in forest.features]))


def score(df: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """``df`` with a score in [-1, 0]; lower is more anomalous."""
    norm = average_path(forest.sample)
    if norm == 0:
        return df.withColumn(name, F.lit(-0.5))
    return df.withColumn(name, F.lit(0.0) - F.pow(F.lit(2.0), (F.lit(0.0) - mean_path(forest)) / F.lit(norm)))


def label(score_column: Column, offset: float, raw: bool = False) -> Column:
    """1 for scores below the offset, else 0; ``raw`` gives -1 and 1."""
    anomalous = score_column < F.lit(offset)
    return F.when(anomalous, -1).otherwise(1) if raw else anomalous.cast("int")
