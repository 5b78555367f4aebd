"""Neighbouring rows of sorted partitions, walked in Arrow batches.

A task reads its range partition in order and gives counts of the steps inside it, and one edge per group: the
group's first and last row there and what is known of the gaps between its rows. Edges are all that
other partitions need, so a group may lie in any number of them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import types as T

# Tasks get these functions with their code, so that workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EDGE = (
    "chunk: int, number: bigint, first: array<string>, last: array<string>, first_us: bigint, last_us: bigint, "
    "n: bigint, s: bigint, q: double, hi: bigint, lo: bigint"
)
_EDGE = pa.struct(
    [("chunk", pa.int32()), ("number", pa.int64()), ("first", pa.list_(pa.string())), ("last", pa.list_(pa.string())), ("first_us", pa.int64()),
     ("last_us", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("q", pa.float64()), ("hi", pa.int64()), ("lo", pa.int64())]
)


def step_schema(by: Sequence[T.StructField]) -> T.StructType:
    """by, kind (null on edges), a, b, n, edge."""
    rest = T.StructType.fromDDL(f"kind string, a string, b string, n bigint, edge struct<{EDGE}>")
    return T.StructType([*[T.StructField(f.name, f.dataType) for f in by], *rest.fields])


def walker(by: Sequence[str], kinds: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task. Batches hold the group columns ``by``, a text per kind (never null), and the time in microseconds."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _walk(batches, len(by), kinds):
            yield out.rename_columns([*by, "kind", "a", "b", "n", "edge"])

    return walk


def _walk(batches: Iterator[pa.RecordBatch], by: int, kinds: Sequence[str]) -> Iterator[pa.RecordBatch]:
    # The last row that was read, and the group it is in as far as it has been read.
    before, open_ = None, None
    chunk, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])])
        if before is not None:
            rows = pa.concat_tables([before, rows])
        rows = rows.combine_chunks()
        before = rows.slice(rows.num_rows - 1)
        same = _same_group(rows, by)
        for i, kind in enumerate(kinds):
            yield from _steps(rows, by, by + i, kind, same)
        groups = _groups(rows, by, len(kinds), same)
        if open_ is not None:
            groups = pa.concat_tables([_continued(open_, groups.slice(0, 1)), groups.slice(1)])
        open_ = groups.slice(groups.num_rows - 1)
        if groups.num_rows > 1:
            yield _edges(groups.slice(0, groups.num_rows - 1), by, len(kinds), chunk, number)
            number += groups.num_rows - 1
    if open_ is not None:
        yield _edges(open_, by, len(kinds), chunk, number)


def _groups(rows: pa.Table, by: int, kinds: int, same: np.ndarray) -> pa.Table:
    """A row per group: by, first and last values, first and last time, and the gaps between its rows as n, s, q, hi, lo."""
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
    ends = np.append(starts[1:], rows.num_rows) - 1
    times = rows.column(by + kinds).combine_chunks()
    known = pc.is_valid(times).to_numpy(zero_copy_only=False)
    values = pc.fill_null(times, 0).to_numpy(zero_copy_only=False)
    # The gap before each row; one needs both times, and the group of the row before.
    there = np.concatenate([[False], same & known[1:] & known[:-1]])
    gaps = np.where(there, np.diff(values, prepend=values[:1]), 0)
    n, s = np.add.reduceat(there.astype(np.int64), starts), np.add.reduceat(gaps, starts)
    mean = s / np.maximum(n, 1)
    around = np.where(there, gaps - np.repeat(mean, ends - starts + 1), 0.0)
    q = np.add.reduceat(around * around, starts)
    limits = np.iinfo(np.int64)
    hi = np.maximum.reduceat(np.where(there, gaps, limits.min), starts)
    lo = np.minimum.reduceat(np.where(there, gaps, limits.max), starts)
    at, to = pa.array(starts), pa.array(ends)
    columns = {f"g{i}": rows.column(i).take(at) for i in range(by)}
    columns |= {f"f{i}": rows.column(by + i).take(at) for i in range(kinds)} | {f"l{i}": rows.column(by + i).take(to) for i in range(kinds)}
    columns |= {"first_us": times.take(at), "last_us": times.take(to), "n": pa.array(n), "s": pa.array(s), "q": pa.array(q)}
    columns |= {"hi": pa.array(hi, mask=n == 0), "lo": pa.array(lo, mask=n == 0)}
    return pa.table(columns)


def _continued(open_: pa.Table, more: pa.Table) -> pa.Table:
    """One row for a group from what was read of it before and what follows; squares are merged pairwise."""
    a, b = open_.to_pylist()[0], more.to_pylist()[0]
    n = a["n"] + b["n"]
    apart = b["s"] / b["n"] - a["s"] / a["n"] if a["n"] and b["n"] else 0.0
    cells = {
        "n": n, "s": a["s"] + b["s"], "q": a["q"] + b["q"] + (apart * apart * a["n"] * b["n"] / n if n else 0.0),
        "hi": max((x for x in (a["hi"], b["hi"]) if x is not None), default=None),
        "lo": min((x for x in (a["lo"], b["lo"]) if x is not None), default=None),
    }
    columns = []
    for field in open_.schema:
        if field.name in cells:
            columns.append(pa.array([cells[field.name]], field.type))
        else:
            columns.append((more if field.name.startswith("l") else open_).column(field.name))
    return pa.table(columns, schema=open_.schema)


def _edges(groups: pa.Table, by: int, kinds: int, chunk: int, number: int) -> pa.RecordBatch:
    groups, size = groups.combine_chunks(), groups.num_rows
    column = lambda name: groups.column(name).combine_chunks()

    def lists(prefix: str) -> pa.ListArray:
        flat = pa.concat_arrays([column(f"{prefix}{i}") for i in range(kinds)]) if kinds else pa.array([], pa.string())
        order = np.arange(kinds * size).reshape(kinds, size).T.ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * kinds, pa.int32()), flat.take(pa.array(order)))

    cells = {
        "chunk": pa.array([chunk] * size, pa.int32()), "number": pa.array(np.arange(number, number + size)), "first": lists("f"), "last": lists("l"),
        **{name: column(name) for name in ("first_us", "last_us", "n", "s", "q", "hi", "lo")},
    }
    none = pa.nulls(size, pa.string())
    edge = pa.StructArray.from_arrays([cells[f.name].cast(f.type) for f in _EDGE], fields=list(_EDGE))
    return pa.RecordBatch.from_arrays(
        [*[column(f"g{i}") for i in range(by)], none, none, none, pa.nulls(size, pa.int64()), edge],
        names=[*[f"g{i}" for i in range(by)], "kind", "a", "b", "n", "edge"],
    )


def _same_group(rows: pa.Table, by: int) -> np.ndarray:
    """For every row but the first, whether it has the group of the row before it."""
    same = np.ones(rows.num_rows - 1, bool)
    for column in rows.columns[:by]:
        values = column.combine_chunks()
        ahead, back = values.slice(1), values.slice(0, len(values) - 1)
        equal = pc.fill_null(pc.equal(ahead, back), False).to_numpy(zero_copy_only=False)
        same &= equal | (pc.is_null(ahead).to_numpy(zero_copy_only=False) & pc.is_null(back).to_numpy(zero_copy_only=False))
    return same


def _steps(rows: pa.Table, by: int, column: int, kind: str, same: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often each value follows each other inside a group, among these rows."""
    at = np.flatnonzero(same)
    if not len(at):
        return
    values = rows.column(column)
    names = [f"g{i}" for i in range(by)]
    pairs = pa.table(
        [*[c.take(pa.array(at)) for c in rows.columns[:by]], values.take(pa.array(at)), values.take(pa.array(at + 1))], names=[*names, "a", "b"]
    )
    counted = pairs.group_by([*names, "a", "b"]).aggregate([([], "count_all")]).combine_chunks()
    size = counted.num_rows
    columns = [counted.column(n).combine_chunks() for n in names]
    yield pa.RecordBatch.from_arrays(
        [
            *columns, pa.array([kind] * size, pa.string()), counted.column("a").combine_chunks(), counted.column("b").combine_chunks(),
            counted.column("count_all").combine_chunks().cast(pa.int64()), pa.nulls(size, _EDGE),
        ],
        names=[*names, "kind", "a", "b", "n", "edge"],
    )
