"""Ordered operators that stay parallel when one group holds most of the rows.

Rows are range-partitioned by (group, order), so a hot group is cut into many chunks. A window
inside each (chunk, group), or a walk along the sorted chunk, finds neighbours, and only one row per
(chunk, group) goes on to join the chunks up. Every plan is one straight line from a single range
partitioning, so the chunk numbers are the same for all steps.

``order`` must identify a row (time, then a unique id): a tie would leave the neighbour open.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventlens.functions.time import micros
from eventlens.operators import steps
from eventlens.operators.joins import join_null_safe
from eventlens.session import settle

CHUNK = "__chunk"


def range_chunks(df: DataFrame, by: Sequence[str], order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """``df`` in range partitions of (by, order), with the partition number as ``CHUNK``.

    Without ``chunks`` the number comes from spark.sql.shuffle.partitions and AQE joins small ones.
    """
    keys = [*by, *order]
    spread = df.repartitionByRange(chunks, *keys) if chunks else df.repartitionByRange(*keys)
    return spread.withColumn(CHUNK, F.spark_partition_id())


def sequence_counts(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    ts: str | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """(by, kind, transition, n, s, q, hi, lo): steps between neighbouring rows, from one ordered pass.

    For each kind in ``values`` a row per transition ``a->b`` with its count ``n``; a null value
    counts as the text ``None``. With ``ts``, one more row of kind ``gap`` holds the number, sum and
    maximum and minimum of the microseconds between neighbours, and the sum of the squares of their
    distances in seconds from their mean.

    Rows move once, into sorted range partitions, where tasks walk them (``steps``). What leaves a task are
    counts, and an edge per group; a group's edges, as many as the partitions it lies in, are joined up in order.
    """
    named = [F.coalesce(column.cast("string"), F.lit("None")).alias(f"v:{kind}") for kind, column in values.items()]
    us = micros(F.col(ts)) if ts else F.lit(None).cast("bigint")
    keys = [*by, *order]
    cut = df.select(*dict.fromkeys(keys), *named, us.alias("v:us"))
    spread = cut.repartitionByRange(chunks, *keys) if chunks else cut.repartitionByRange(*keys)
    ordered = spread.sortWithinPartitions(*keys).select(*by, *[f"`v:{kind}`" for kind in values], "`v:us`")
    schema = steps.step_schema([df.schema[name] for name in by])
    walked = ordered.mapInArrow(steps.walker(list(by), list(values)), schema)
    grouped = walked.groupBy(*by, "kind", "a", "b").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("edge")).alias("edges"))
    zero, none, no_text = F.lit(0).cast("bigint"), F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def row(kind: Column, transition: Column, n: Column, s: Column, q: Column, hi: Column, lo: Column) -> Column:
        cells = {"kind": kind, "transition": transition, "n": n, "s": s, "q": q, "hi": hi, "lo": lo}
        return F.struct(*[c.alias(name) for name, c in cells.items()])

    edges = F.col("edges")
    own = row(F.col("kind"), F.concat("a", F.lit("->"), "b"), F.col("n"), zero, F.lit(0.0), none, none)
    pairs = F.when(F.size(edges) > 1, F.sequence(F.lit(1), F.size(edges) - 1)).otherwise(F.array().cast("array<int>"))

    def across(i: int, kind: str) -> Column:
        """The steps of a kind from each edge to the next."""
        step = lambda j: F.concat(F.get(edges, j - 1)["last"][i], F.lit("->"), F.get(edges, j)["first"][i])
        return F.transform(pairs, lambda j: row(F.lit(kind), step(j), F.lit(1).cast("bigint"), zero, F.lit(0.0), none, none))

    parts = [across(i, kind) for i, kind in enumerate(values)]
    if ts:
        gaps = _joined_gaps(edges)
        parts.append(F.array(row(F.lit("gap"), no_text, gaps["n"], gaps["s"], gaps["q"], gaps["hi"], gaps["lo"])))
    is_edge = F.col("kind").isNull()
    found = grouped.select(*by, F.inline(F.when(is_edge, F.concat(*parts)).otherwise(F.array(own))))
    return found.groupBy(*by, "kind", "transition").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), (F.sum("q") / F.lit(1e12)).alias("q"), F.max("hi").alias("hi"), F.min("lo").alias("lo")
    )


def _joined_gaps(edges: Column) -> Column:
    """Number, sum, squares around the mean, largest and smallest of the gaps inside edges and from each edge to the next."""
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    cells = (("n", zero), ("s", zero), ("q", F.lit(0.0)), ("hi", none), ("lo", none), ("last_us", none))
    start = F.struct(*[c.alias(name) for name, c in cells])

    def with_gaps(a: Column, n: Column, s: Column, q: Column, hi: Column, lo: Column, last: Column) -> Column:
        apart = F.try_divide(s, n) - F.try_divide(a["s"], a["n"])
        cross = F.coalesce(apart * apart * F.try_divide(a["n"] * n, a["n"] + n), F.lit(0.0))
        return F.struct(
            (a["n"] + n).alias("n"), (a["s"] + s).alias("s"), (a["q"] + q + cross).alias("q"),
            F.greatest(a["hi"], hi).alias("hi"), F.least(a["lo"], lo).alias("lo"), last.alias("last_us"),
        )

    def add(a: Column, edge: Column) -> Column:
        bridge = edge["first_us"] - a["last_us"]
        there = bridge.isNotNull().cast("bigint")
        met = with_gaps(a, there, F.coalesce(bridge, zero), F.lit(0.0), bridge, bridge, edge["last_us"])
        return with_gaps(met, edge["n"], edge["s"], edge["q"], edge["hi"], edge["lo"], edge["last_us"])

    return F.aggregate(edges, start, add)


def transition_counts(
    df: DataFrame, by: Sequence[str], order: Sequence[str], values: Mapping[str, Column], chunks: int | None = None
) -> DataFrame:
    """(by, kind, transition, n): how often one value directly follows another."""
    return sequence_counts(df, by, order, values, None, chunks).select(*by, "kind", "transition", "n")


def gap_stats(
    df: DataFrame, by: Sequence[str], ts: str, order: Sequence[str], chunks: int | None = None
) -> DataFrame:
    """(by, n, mean, max, min, std) of the seconds between neighbouring rows; ``std`` is the sample one."""
    total = sequence_counts(df, by, order, {}, ts, chunks)
    return total.select(*by, "n", *[c.alias(name.removeprefix("gap_")) for name, c in gap_measures(F.col("n")).items()])


def gap_measures(gaps: Column) -> dict[str, Column]:
    """Mean, max, min and sample deviation in seconds from the columns of a ``gap`` row."""
    n = F.nullif(gaps, F.lit(0))
    mean = F.col("s") / n / F.lit(1e6)
    return {
        "gap_mean": mean,
        "gap_max": F.col("hi") / F.lit(1e6),
        "gap_min": F.col("lo") / F.lit(1e6),
        "gap_std": F.sqrt(F.try_divide(F.col("q"), n - 1)),
    }


def rolling_entropy(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    rows: int = 50,
    min_entropy: float = 0.1,
    chunks: int | None = None,
) -> DataFrame:
    """Each row with the entropy of ``value`` over its group's last ``rows`` rows, kept from ``min_entropy`` on.

    With c the count of each value in the window, the entropy is log2(N) - sum(c * log2 c) / N. A
    row changes that sum when it enters, by its value's count in the rows before it, and again when
    it leaves, by the count in the rows after it: two running sums, no list per row.

    The first rows of a chunk look back into earlier chunks, so every chunk gets a copy of the last
    ``rows - 1`` rows of its group before it, from as many chunks as they lie in. A hot group's chunks stay
    apart.
    """
    back = rows - 1
    v = F.coalesce(F.col(value).cast("string"), F.lit("None")).alias("v")
    inside = W.partitionBy(CHUNK, *by)
    # Written once: the rows and the copies below must see the same chunks.
    cut = range_chunks(df.select(*by, *order, value, v), by, order, chunks)
    placed = settle(cut.withColumns({"place": F.row_number().over(inside.orderBy(*order)), "size": F.count("*").over(inside)}))
    copies = _followers(placed, by, back)
    tails = placed.where(F.col("place") > F.col("size") - back)
    halo = (
        join_null_safe(tails, copies, [*by, CHUNK])
        .where(F.col("size") - F.col("place") + F.col("between") < back)
        .select(*by, *order, value, "v", F.col("target").alias(CHUNK), F.lit(False).alias("own"))
    )
    joined = placed.select(*by, *order, value, "v", CHUNK, F.lit(True).alias("own")).unionByName(halo)
    ranked = joined.withColumn("rank", F.row_number().over(inside.orderBy(*order)))
    same = W.partitionBy(CHUNK, *by, "v").orderBy("rank")
    counted = ranked.withColumns(
        {
            "enters": _step(F.count("*").over(same.rangeBetween(-back, 0))),
            "leaves": _step(F.count("*").over(same.rangeBetween(0, back))),
        }
    )
    running = inside.orderBy("rank")
    gone = F.coalesce(F.sum("leaves").over(running.rowsBetween(W.unboundedPreceding, -rows)), F.lit(0.0))
    total = F.sum("enters").over(running.rowsBetween(W.unboundedPreceding, 0)) - gone
    held = F.least(F.col("rank"), F.lit(rows)).cast("double")
    return (
        counted.withColumn("rolling_entropy", F.greatest(F.log2(held) - total / held, F.lit(0.0)))
        .where(F.col("own") & (F.col("rolling_entropy") >= min_entropy))
        .select(*by, *order, value, "rolling_entropy")
    )


def _followers(placed: DataFrame, by: Sequence[str], back: int) -> DataFrame:
    """(by, CHUNK, target, between): the group's later chunks with under ``back`` of its rows in between."""
    sizes = placed.groupBy(*by, CHUNK).agg(F.count("*").alias("size"))
    next_ones = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(1, max(back, 1))
    listed = sizes.select(*by, CHUNK, F.collect_list(F.struct(F.col(CHUNK).alias("target"), "size")).over(next_ones).alias("later"))
    steps = F.transform(
        "later",
        lambda x, i: F.struct(
            x["target"].alias("target"),
            F.aggregate(F.slice("later", F.lit(1), i), F.lit(0).cast("bigint"), lambda total, y: total + y["size"]).alias("between"),
        ),
    )
    return listed.select(*by, CHUNK, F.inline(steps)).where(F.col("between") < back)


def _step(count: Column) -> Column:
    """What a count of c adds to sum(c * log2 c) over a count of c - 1."""
    c = count.cast("double")
    return c * F.log2(c) - F.when(c > 1, (c - 1) * F.log2(c - 1)).otherwise(0.0)


def exact_quantile(df: DataFrame, value: str, q: float, chunks: int | None = None) -> DataFrame:
    """One row (n, quantile): the exact quantile of ``value`` with linear interpolation.

    Equal values are counted first. Each chunk of the sorted counts keeps its running count, the
    chunk totals give the offset, and only the one or two values at the wanted rank remain.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    rows = range_chunks(counts, [], [value], chunks)
    running = W.partitionBy(CHUNK).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    # Written once: the chunk totals and the lookup below must see the same chunks.
    placed = settle(rows.withColumn("upto", F.sum("n").over(running)))
    before = W.orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(CHUNK).agg(F.sum("n").alias("in_chunk"))
    offsets = totals.withColumn("offset", F.coalesce(F.sum("in_chunk").over(before), F.lit(0))).withColumn(
        "total", F.sum("in_chunk").over(W.partitionBy())
    )
    rank = (F.col("total") - 1) * F.lit(float(q))
    end = F.col("offset") + F.col("upto")
    low, high = F.floor(rank), F.ceil(rank)

    def covers(r: Column) -> Column:
        return (r < end) & (r >= end - F.col("n"))

    picked = (
        placed.join(offsets, CHUNK)
        .where(covers(low) | covers(high))
        .agg(
            F.max("total").alias("n"),
            F.max(F.when(covers(low), F.col(value))).alias("lo"),
            F.max(F.when(covers(high), F.col(value))).alias("hi"),
            F.max(rank - low).alias("part"),
        )
    )
    return picked.select("n", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("quantile"))
