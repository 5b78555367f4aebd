"""The shared frequency tables behind most features.

One unpivot and one aggregation count every value of every field; a second aggregation groups
those counts by their size. Statistics then come from that small table (see functions.entropy).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from eventlens.functions.entropy import SMOOTHING, entropy_basic, entropy_of_sizes, entropy_smoothed, sizes_total


def frequencies(df: DataFrame, by: Sequence[str], fields: Mapping[str, Column]) -> DataFrame:
    """(by, field, value, n); null is a value of its own here, so that all-null fields stay visible."""
    # Prefixed names, because a field may also be one of the scope columns.
    cast = df.select(*by, *[c.cast("string").alias(f"f:{name}") for name, c in fields.items()])
    long = cast.unpivot(list(by), [f"`f:{name}`" for name in fields], "field", "value")
    counted = long.groupBy(*by, "field", "value").agg(F.count("*").alias("n"))
    return counted.withColumn("field", F.expr("substring(field, 3)"))


def pair_frequencies(df: DataFrame, by: Sequence[str], pairs: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(by, pair, a, b, n) for rows whose first part is not null; the second may be."""
    structs = [
        F.struct(F.lit(name).alias("pair"), a.cast("string").alias("a"), b.cast("string").alias("b"))
        for name, (a, b) in pairs.items()
    ]
    long = df.select(*by, F.inline(F.array(*structs)))
    return long.where(F.col("a").isNotNull()).groupBy(*by, "pair", "a", "b").agg(F.count("*").alias("n"))


def field_stats(
    freq: DataFrame, by: Sequence[str], keep_values: Sequence[str] = (), carried: Sequence[str] = ()
) -> DataFrame:
    """(by, field, value, distinct, rows, max_n, mean_n, entropy, entropy_smoothed).

    ``value`` is null on the row that describes the field. Fields in ``keep_values`` also get one
    row per value, whose ``rows`` is that value's count. Columns in ``carried`` keep their maximum.
    """
    counted = freq.withColumn("n", F.when(F.col("value").isNotNull(), F.col("n")))
    whole = F.lit(None).cast("string")
    if keep_values:
        copies = F.when(
            F.col("field").isin(list(keep_values)) & F.col("value").isNotNull(), F.array(whole, F.col("value"))
        ).otherwise(F.array(whole))
        counted = counted.withColumn("value", F.explode(copies))
    else:
        counted = counted.withColumn("value", whole)
    sizes = counted.groupBy(*by, "field", "value", "n").agg(
        F.count("n").alias("m"), *[F.max(c).alias(c) for c in carried]
    )
    group = [*by, "field", "value"]
    total = F.sum(F.col("n") * F.col("m")).over(W.partitionBy(*group))
    n, m = F.col("n"), F.col("m")
    return (
        sizes.withColumn("total", total)
        .groupBy(*group)
        .agg(
            F.sum("m").alias("distinct"),
            F.coalesce(F.max("total"), F.lit(0)).alias("rows"),
            F.max("n").alias("max_n"),
            F.try_divide(F.sum(n * m), F.sum("m")).alias("mean_n"),
            entropy_basic(n, m).alias("entropy"),
            entropy_smoothed(n, m, F.col("total")).alias("entropy_smoothed"),
            *[F.max(c).alias(c) for c in carried],
        )
    )


def tagged_counts(
    df: DataFrame,
    by: Sequence[str],
    fields: Mapping[str, Column],
    singles: Sequence[str],
    pairs: Sequence[tuple[str, str]] = (),
    scopes: Mapping[str, Mapping[int, Column]] | None = None,
) -> DataFrame:
    """(by, tag, a, b, n): values of single fields and of pairs, counted in one pass.

    Every row becomes one tagged row per field and pair, and one aggregation with map-side combine counts
    them all. A field's tag is its name, a pair's is ``a+b``; null is a value of its own in a single field and in a
    pair's second part, while rows with a null first part don't count. ``scopes`` gives windows of their own to tags: by
    width the start of the row's window, which becomes the column ``scope`` next to ``width``.
    """
    entries = [(name, name, None) for name in singles] + [(f"{a}+{b}", a, b) for a, b in pairs]
    none, none_name = F.lit(None).cast("string"), "f:"
    starts = {f"s:{w}": c for own in (scopes or {}).values() for w, c in own.items()}
    # Prefixed names, because a field may also be one of the scope columns.
    cast = df.select(
        *by, *[c.alias(n) for n, c in starts.items()], *[c.cast("string").alias(f"f:{n}") for n, c in fields.items()], none.alias(none_name)
    )
    rows = []
    for tag, a, b in entries:
        values = f"`f:{a}`, `{f'f:{b}' if b else none_name}`"
        if scopes is None:
            rows.append(f"({values}) AS `{tag}`")
        else:
            rows += [f"(`s:{w}`, {values}) AS `{w}|{tag}`" for w in scopes[tag]]
    names = "a, b" if scopes is None else "scope, a, b"
    long = df.sparkSession.sql(f"SELECT * FROM {{cast}} UNPIVOT INCLUDE NULLS (({names}) FOR tag IN ({', '.join(rows)}))", cast=cast)
    if scopes is not None:
        by = [*by, "width", "scope"]
        long = long.withColumn("width", F.substring_index("tag", "|", 1).cast("int")).withColumn("tag", F.substring_index("tag", "|", -1))
    if pairs:
        long = long.where(F.col("a").isNotNull() | ~F.col("tag").isin([f"{a}+{b}" for a, b in pairs]))
    return long.groupBy(*by, "tag", "a", "b").agg(F.count("*").alias("n"))


def rolled_up(counts: DataFrame, widths: Mapping[str, Mapping[int, Column]]) -> DataFrame:
    """``tagged_counts`` of windows (width, scope), with the counts of each tag's windows added up to wider ones.

    ``widths`` gives for every tag the widths that are wanted and the start of the wider window a counted one
    (column ``scope``) lies in. Counts are merged; no event is read again.
    """
    wanted = [
        F.when(F.col("tag") == tag, F.array(*[F.struct(F.lit(w).alias("width"), start.alias("scope")) for w, start in own.items()]))
        for tag, own in widths.items()
    ]
    moved = counts.select("tag", "a", "b", "n", F.inline(F.coalesce(*wanted)))
    return moved.groupBy("width", "scope", "tag", "a", "b").agg(F.sum("n").alias("n"))


def count_sizes(
    counts: DataFrame, by: Sequence[str], keep_values: Sequence[str] = (), key_pairs: Sequence[str] = (), joint_pairs: Sequence[str] = ()
) -> DataFrame:
    """(by, tag, view, label, size, m, rows): ``tagged_counts`` grouped by how large the counts are.

    View ``field``: m values occur ``size`` times; fields in ``keep_values`` also get a row per value, its label.
    View ``joint``: the same of pairs that have both parts. View ``keys``: per first part, the label, its rows
    that have a second part and the number m of different ones.
    """
    n, tag, a, both = F.col("n"), F.col("tag"), F.col("a"), F.col("b").isNotNull()
    none, zero, one = F.lit(None).cast("string"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    no_size = F.lit(None).cast("bigint")

    def view(name: str, label: Column, size: Column, m: Column, rows: Column) -> Column:
        return F.struct(F.lit(name).alias("view"), label.alias("label"), size.alias("size"), m.alias("m"), rows.alias("rows"))

    pairs = [*key_pairs, *joint_pairs]
    known = a.isNotNull()
    single = ~tag.isin(pairs) if pairs else F.lit(True)
    views = [F.when(single, view("field", none, F.when(known, n), F.when(known, one).otherwise(zero), zero))]
    if keep_values:
        views.append(F.when(tag.isin(list(keep_values)) & known, view("field", a, n, one, zero)))
    if key_pairs:
        views.append(F.when(tag.isin(list(key_pairs)), view("keys", a, no_size, F.when(both, one).otherwise(zero), F.when(both, n).otherwise(zero))))
    if joint_pairs:
        views.append(F.when(tag.isin(list(joint_pairs)) & both, view("joint", none, n, one, zero)))
    long = counts.select(*by, "tag", F.inline(F.array(*views))).where(F.col("view").isNotNull())
    return long.groupBy(*by, "tag", "view", "label", "size").agg(F.sum("m").alias("m"), F.sum("rows").alias("rows"))


def listed_sizes(condition: Column) -> Column:
    """Aggregate over ``count_sizes``: the array of (n, m) of the rows for which the condition holds; at most sqrt(2N) long."""
    return F.array_sort(F.collect_list(F.when(condition & (F.col("m") > 0), F.struct(F.col("size").alias("n"), "m"))))


def size_measures(sizes: Column, total: Column) -> dict[str, Column]:
    """Statistics of a field or of pairs from ``listed_sizes`` and their total."""
    distinct = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda d, x: d + x["m"])
    return {
        "distinct": distinct,
        "rows": total,
        "max_n": F.get(sizes, F.size(sizes) - 1)["n"],
        "mean_n": F.try_divide(total, distinct),
        "entropy": entropy_of_sizes(sizes, total),
        "entropy_smoothed": entropy_of_sizes(sizes, total, SMOOTHING),
    }


def tagged_stats(
    counts: DataFrame, by: Sequence[str], keep_values: Sequence[str] = (), key_pairs: Sequence[str] = (), joint_pairs: Sequence[str] = ()
) -> DataFrame:
    """(by, tag, view, label, distinct, rows, max_n, mean_n, entropy, entropy_smoothed, rows_avg, ..., distinct_min) from ``tagged_counts``.

    ``label`` is null but on rows of single values, see ``count_sizes``. Columns ``rows_*`` and ``distinct_*`` are
    averages, largest and smallest of the keys of a pair.
    """
    keys = F.col("view") == "keys"
    spread = [f(c).alias(f"{c}_{name}") for c in ("rows", "m") for name, f in (("sum", F.sum), ("max", F.max), ("min", F.min))]
    grouped = (
        count_sizes(counts, by, keep_values, key_pairs, joint_pairs)
        .groupBy(*by, "tag", "view", F.when(~keys, F.col("label")).alias("label"))
        .agg(listed_sizes(~keys).alias("sizes"), F.count(F.lit(1)).alias("keys"), *spread)
    )
    # The total is a column of its own, or every element of the list would add it up again.
    totals = grouped.withColumn("rows", sizes_total(F.col("sizes")))
    measures = size_measures(F.col("sizes"), F.col("rows"))
    return totals.select(
        *by, "tag", "view", "label", *[c.alias(name) for name, c in measures.items()],
        *[
            c
            for name, own in (("rows", "rows"), ("distinct", "m"))
            for c in (F.try_divide(f"{own}_sum", "keys").alias(f"{name}_avg"), F.col(f"{own}_max").alias(f"{name}_max"), F.col(f"{own}_min").alias(f"{name}_min"))
        ],
    )


def pair_stats(
    pairs: DataFrame, by: Sequence[str], key_pairs: Sequence[str], joint_pairs: Sequence[str]
) -> DataFrame:
    """(by, view, pair, rows_*, distinct_*, entropy, entropy_smoothed) with * in avg, max, min.

    ``view='keys'``: per first part the rows with a second part and how many different ones, over
    all first parts. ``view='joint'``: entropy of the pairs that have both parts.
    """
    n, both = F.col("n"), F.col("b").isNotNull()
    as_key = F.struct(F.lit("keys").alias("view"), F.col("a").alias("key"), F.lit(None).cast("bigint").alias("size"))
    as_joint = F.struct(F.lit("joint").alias("view"), F.lit(None).cast("string").alias("key"), n.alias("size"))
    wanted = F.array(
        F.when(F.col("pair").isin(list(key_pairs)), as_key), F.when(F.col("pair").isin(list(joint_pairs)) & both, as_joint)
    )
    views = pairs.select(*by, "pair", "n", both.alias("both"), F.inline(wanted)).where(F.col("view").isNotNull())
    grouped = views.groupBy(*by, "pair", "view", "key", "size").agg(
        F.sum(F.when(F.col("both"), n).otherwise(0)).alias("rows"), F.count_if("both").alias("distinct")
    )
    # All keys of a pair become one row, each size of a joint pair keeps its own.
    sizes = grouped.groupBy(*by, "pair", "view", "size").agg(
        F.count("*").alias("keys"),
        *[f(c).alias(f"{c}_{name}") for c in ("rows", "distinct") for name, f in (("sum", F.sum), ("max", F.max), ("min", F.min))],
    )
    size, m = F.col("size"), F.col("distinct_sum")
    total = F.sum(size * m).over(W.partitionBy(*by, "pair", "view"))
    measures = [
        measure
        for c in ("rows", "distinct")
        for measure in (
            (F.sum(f"{c}_sum") / F.sum("keys")).alias(f"{c}_avg"),
            F.max(f"{c}_max").alias(f"{c}_max"),
            F.min(f"{c}_min").alias(f"{c}_min"),
        )
    ]
    return (
        sizes.withColumn("total", total)
        .groupBy(*by, "pair", "view")
        .agg(
            *measures,
            entropy_basic(size, m).alias("entropy"),
            entropy_smoothed(size, m, F.col("total")).alias("entropy_smoothed"),
        )
    )
