"""Merkle manifest of a dataset: hash trees whose nodes are labelled with the leaf ranks they cover.

Every row is a leaf, the SHA-256 of its framed values. The leaves of a source, in the order of their id, are
numbered; a node is labelled with the half-open interval of the ranks below it. ``ARITY`` neighbouring nodes
make their parent, until a source has one node, its subroot; the subroots, in the order of their source, make
the root in the same way. Every level is a table of its own. From the top down, a containment join per level
attaches to each node the parent whose interval holds its own (both meet in the bucket of the parent's first
rank), and what is left of the parent's interval without the node's own names its siblings. A proof is the
list of siblings of a leaf and all its ancestors, which ``fold`` turns back into the root.

Ranks come from one range shuffle by (source, id, leaf): sorted partitions are numbered as they are written,
and one row per partition and source turns these numbers into ranks, so a source with a third of all rows is
spread like any other. A group of a level is a parent with its children. Each level holds a third of the rows
of the one below, and the rows that move hold digests, never texts. The driver sees two numbers, the leaves of
the largest source and the number of sources.

Cases: null values are framed as ``-`` (an empty text is ``0:``). Rows without an id come first in their
source, rows without a source are the first source. Rows with the same id are leaves each, ordered by their
digest; equal rows get equal leaves and may get each other's proof, which is as valid. A text of any length
is one value. A row without siblings at any level (the only one) has the empty proof and is the root. An
empty table gives an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventlens.session import settle

ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

# monotonically_increasing_id puts the partition's number above this bit.
PARTITION_BIT = 33


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes; half of what the hexadecimal text takes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(values: Sequence[Column]) -> Column:
    """Digest of the values, each framed by its length in bytes."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]))


PATH = "array<struct<left: binary, right: binary>>"


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    id_column: str = "doc_id",
    source_column: str = "source",
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, path, and what ``carry`` computes from the row.

    Digests are binary. ``path`` lists, from the leaf's siblings up to the root's children, the digests to the
    left and to the right of the way up: array of (left, right), each digests one after the other.
    """
    carry = carry or {}
    rows = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.col(f"`{source_column}`").alias("source"),
        leaf([F.col(f"`{c}`") for c in columns]).alias("digest"),
        F.struct(F.lit(0).alias("none"), *[c.alias(name) for name, c in carry.items()]).alias("carried"),
    )
    leaves, sources = _labelled(rows)
    levels = _levels(leaves)
    tops = reduce(DataFrame.unionByName, [_tops(nodes, k).select("tree", "digest") for k, nodes in enumerate(levels)])
    span = [F.lit(0).cast("long").alias("tree"), F.lit(sources).cast("long").alias("leaves"), F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi")]
    upper = _levels(settle(tops.select(*span, "digest", F.col("tree").alias("source_tree"))))
    root = _tops(upper[-1], len(upper) - 1).select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = settle(_descend(upper, root).select(F.col("source_tree").alias("tree"), F.col("digest").alias("subroot"), "root", "path"))
    return _descend(levels, above).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.col(f"carried.`{name}`").alias(name) for name in carry]
    )


def proof(path: Column) -> Column:
    """The siblings' digests from the leaf up, as one hexadecimal text."""
    return F.array_join(F.transform(path, lambda step: F.concat(as_hex(step["left"]), as_hex(step["right"]))), "")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, start, lambda own, step: digest(F.concat(as_hex(step["left"]), as_hex(own), as_hex(step["right"]))))


def _labelled(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows with tree (the rank of their source), leaves (of the tree), lo and hi; and the number of trees."""
    numbered = _numbered(rows, ["source", "doc_id", "digest"])
    parts = settle(_parts(numbered, ["source"]))
    names = _numbered(parts.groupBy("source").agg(F.sum("size").alias("leaves")), ["source"])
    before = W.rowsBetween(W.unboundedPreceding, -1)
    # One row per partition here, and below one per partition that a source lies in.
    name_parts = _parts(names, []).withColumn("offset", F.coalesce(F.sum("size").over(before.orderBy("part")), F.lit(0)))
    trees = names.withColumn("part", _part()).join(name_parts, "part")
    trees = settle(trees.select(F.col("source").alias("named"), (F.col("number") - F.col("first") + F.col("offset")).alias("tree"), "leaves"))
    earlier = before.partitionBy("source").orderBy("part")
    known = parts.withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    known = known.join(trees, F.col("source").eqNullSafe(F.col("named"))).select("named", F.col("part").alias("in_part"), "first", "offset", "tree", "leaves")
    here = (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("named"))
    rank = F.col("number") - F.col("first") + F.col("offset")
    placed = numbered.withColumn("part", _part()).join(known, here)
    return settle(placed.select("doc_id", "digest", "carried", "tree", "leaves", rank.alias("lo"), (rank + 1).alias("hi"))), trees.count()


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with ``number``, which ascends in their order, without gaps inside a partition. Written, so that it stays."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(ordered.withColumn("number", F.monotonically_increasing_id()))


def _part() -> Column:
    return F.shiftright("number", PARTITION_BIT)


def _parts(numbered: DataFrame, by: Sequence[str]) -> DataFrame:
    """part, by, first number, size."""
    return numbered.groupBy(_part().alias("part"), *by).agg(F.min("number").alias("first"), F.count("*").alias("size"))


def _bucket(width: int) -> Column:
    """The first rank of the interval of this width that a node lies in."""
    return F.col("lo") - F.col("lo") % F.lit(width)


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """Tables of nodes (tree, leaves, lo, hi, digest, children), level by level; the first are the leaves, without children."""
    out, width = [leaves], 1
    largest = leaves.agg(F.max("leaves")).first()[0] or 1
    while width < largest:
        grouped = (
            out[-1]
            .where(F.col("leaves") > width)
            .groupBy("tree", "leaves", _bucket(width * ARITY).alias("bucket"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        )
        joined = F.array_join(F.transform("children", lambda child: as_hex(child["digest"])), "")
        out.append(settle(grouped.select("tree", "leaves", "lo", "hi", digest(joined).alias("digest"), "children")))
        width *= ARITY
    return out


def _tops(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of a level that are alone in their tree."""
    return nodes.where((F.col("leaves") <= ARITY**level) & (F.col("leaves") > (ARITY ** (level - 1) if level else 0)))


def _descend(levels: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with their path and the columns of ``above``, which holds the path over each tree's top."""
    told = [c for c in above.columns if c not in ("tree", "path")]
    found = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        top = _tops(nodes, level).join(above, "tree")
        if found is None:
            found = top
            continue
        width = ARITY ** (level + 1)
        parents = found.select(
            F.col("tree").alias("up_tree"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.col("children").alias("below"),
            F.col("path").alias("up_path"), *told, _bucket(width).alias("up_bucket"),
        )
        inner = nodes.where(F.col("leaves") > ARITY**level).withColumn("bucket", _bucket(width))
        held = (F.col("up_lo") <= F.col("lo")) & (F.col("hi") <= F.col("up_hi"))
        attached = inner.join(parents, (F.col("tree") == F.col("up_tree")) & (F.col("bucket") == F.col("up_bucket")) & held)
        # What the parent's interval holds before and behind the node's own.
        step = F.struct(
            _digests(F.filter("below", lambda c: c["hi"] <= F.col("lo"))).alias("left"),
            _digests(F.filter("below", lambda c: c["lo"] >= F.col("hi"))).alias("right"),
        )
        path = F.concat(F.array(step), F.col("up_path")).cast(PATH).alias("path")
        found = top.unionByName(attached.select(*nodes.columns, path, *told))
    return found


def _digests(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(bytearray()), lambda all_, node: F.concat(all_, node["digest"]))
