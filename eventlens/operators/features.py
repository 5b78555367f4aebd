"""Feature families as long tables (by, family, feature, value DOUBLE).

A family is a list of measures on shared frequency tables plus plain aggregates, so any choice of
families costs one frequency pass, one pair pass, one aggregate pass, and one ordered pass per
sequence measure. ``by`` names the scope columns; an empty ``by`` treats the table as one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from math import gcd
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.functions.text import file_extension, path_depth, special_char_ratio
from eventlens.functions.numbers import known
from eventlens.functions.time import floor_time, time_parts
from eventlens.operators import frequency, ordered, tfidf
from eventlens.session import settle

# (family, field, statistic, feature name). Statistics are columns of frequency.tagged_stats.
FIELD_MEASURES = [
    *[
        (f"{ip}", ip, stat, f"{ip}_{suffix}")
        for ip in ("source_ip", "destination_ip")
        for stat, suffix in (("distinct", "count"), ("max_n", "max_frequency"), ("mean_n", "mean_frequency"))
    ],
    ("user", "username", "distinct", "user_count"),
    ("user", "username", "max_n", "user_max_activity"),
    ("user", "username", "mean_n", "user_mean_activity"),
    ("user", "command", "distinct", "unique_commands"),
    ("user", "command", "entropy", "command_entropy"),
    ("user", "file_path", "distinct", "unique_files_accessed"),
    ("user", "file_path", "entropy", "file_access_entropy"),
    ("process", "process_name", "distinct", "process_count"),
    ("process", "process_name", "max_n", "process_max_frequency"),
    ("process", "process_name", "mean_n", "process_mean_frequency"),
    ("network", "connection_id", "distinct", "unique_connections"),
    ("network", "protocol", "entropy", "protocol_entropy"),
    ("syscall", "syscall", "distinct", "unique_syscalls"),
    ("syscall", "syscall", "entropy", "syscall_entropy"),
    ("syscall", "parent_process", "distinct", "unique_parent_processes"),
    ("syscall", "parent_process", "entropy", "process_creation_entropy"),
    ("cmdline", "command", "distinct", "unique_commands"),
    ("cmdline", "command", "entropy", "command_entropy"),
    ("cmdline", "arguments", "distinct", "unique_argument_patterns"),
    ("cmdline", "arguments", "entropy", "argument_entropy"),
    ("text", "command", "entropy_smoothed", "command_entropy"),
    ("text", "username", "entropy_smoothed", "username_entropy"),
    ("text", "file_extension", "entropy_smoothed", "file_extension_entropy"),
    ("sequence", "hour", "entropy_smoothed", "hour_entropy"),
    ("sequence", "day_of_week", "entropy_smoothed", "day_of_week_entropy"),
    *[
        ("entropy", field, "entropy_smoothed", f"{field}_entropy")
        for field in (
            "event_type",
            "username",
            "process_name",
            "source_ip",
            "destination_ip",
            "alert_level",
            "command",
            "file_path",
        )
    ],
]

# (family, field, name prefix, name suffix): one feature per value of the field.
VALUE_MEASURES = [
    ("event_type", "event_type", "event_type_", ""),
    ("alert", "alert_level", "alert_level_", "_count"),
    ("network", "protocol", "protocol_", "_count"),
]

# (first column, second column, noun, key): rows and distinct second values per key.
KEY_MEASURES = [
    ("username", "command", "commands", "user"),
    ("username", "file_path", "files", "user"),
    ("process_name", "command", "commands", "process"),
    ("source_ip", "command", "commands", "ip"),
]

JOINT_MEASURES = [
    ("username", "command", "username_command_joint_entropy"),
    ("source_ip", "destination_ip", "ip_joint_entropy"),
]

# Order matters where two families give the same feature name: the later one wins.
BASIC = ("event_type", "source_ip", "destination_ip", "user", "process", "alert", "network", "syscall", "cmdline")
ADVANCED = ("text", "sequence", "correlation", "entropy")
FAMILIES = BASIC + ADVANCED


def with_scope(df: DataFrame, seconds: int = 3600, ts: str = "timestamp", name: str = "scope") -> DataFrame:
    """``df`` with the start of each row's tumbling window, null for rows without a time."""
    return df.withColumn(name, floor_time(F.col(ts), seconds))


# Computed fields: name -> (column it needs, expression).
DERIVED: dict[str, tuple[str, Callable[[], Column]]] = {
    "hour": ("timestamp", lambda: time_parts(F.col("timestamp"))["hour"]),
    "day_of_week": ("timestamp", lambda: time_parts(F.col("timestamp"))["day_of_week"]),
    "file_extension": ("file_path", lambda: file_extension(F.col("file_path"))),
}

HIGH_ALERT = 12

# (family, feature name, columns needed, aggregate of the failed-login event type).
AGGREGATES: list[tuple[str, str, tuple[str, ...], Callable[[str], Column]]] = [
    ("user", "failed_login_count", ("username", "event_type"), lambda login: F.count_if(F.col("event_type") == login)),
    ("alert", "high_severity_count", ("alert_level",), lambda _: F.count_if(F.col("alert_level") >= HIGH_ALERT)),
    ("network", "total_packets", ("packet_count",), lambda _: F.coalesce(F.sum("packet_count"), F.lit(0))),
    ("network", "avg_packets_per_connection", ("packet_count",), lambda _: F.avg("packet_count")),
    ("network", "total_bytes", ("byte_count",), lambda _: F.coalesce(F.sum("byte_count"), F.lit(0))),
    ("network", "avg_bytes_per_connection", ("byte_count",), lambda _: F.avg("byte_count")),
    ("cmdline", "avg_execution_time", ("execution_time",), lambda _: F.avg(known(F.col("execution_time")))),
    ("cmdline", "std_execution_time", ("execution_time",), lambda _: F.stddev_samp(known(F.col("execution_time")))),
    ("text", "command_avg_length", ("command",), lambda _: F.avg(F.char_length("command"))),
    ("text", "command_max_length", ("command",), lambda _: F.max(F.char_length("command"))),
    ("text", "command_min_length", ("command",), lambda _: F.min(F.char_length("command"))),
    ("text", "command_special_char_ratio", ("command",), lambda _: F.avg(special_char_ratio(F.col("command")))),
    ("text", "username_special_char_ratio", ("username",), lambda _: F.avg(special_char_ratio(F.col("username")))),
    ("text", "path_avg_depth", ("file_path",), lambda _: F.avg(path_depth(F.col("file_path")))),
]


class Measure(NamedTuple):
    """One kind of output row, as SQL over an input row; a null name means no row."""

    family: str
    name: str
    value: str


def _long(df: DataFrame, by: Sequence[str], measures: Iterable[Measure]) -> DataFrame:
    """The measures of every input row as (by, family, feature, value)."""
    rows = ", ".join(
        f"struct('{m.family}' AS family, {m.name} AS feature, CAST({m.value} AS DOUBLE) AS value)" for m in measures
    )
    return df.select(*by, F.expr(f"inline(array({rows}))")).where("feature IS NOT NULL")


def _chosen(columns: Sequence[str], families: Sequence[str]) -> tuple[list, list, dict, dict]:
    """What the families need of a table with these columns: field measures, value measures, key pairs and joint pairs (tag -> name)."""

    def usable(*fields: str) -> bool:
        return all((DERIVED[f][0] if f in DERIVED else f) in columns for f in fields)

    # The user family as a whole hangs on the username column.
    own = [f for f in families if f != "user" or "username" in columns]
    stats = [m for m in FIELD_MEASURES if m[0] in own and usable(m[1])]
    values = [m for m in VALUE_MEASURES if m[0] in own and usable(m[1])]
    keys = {f"{a}+{b}": f"{noun}_per_{key}" for a, b, noun, key in KEY_MEASURES if "correlation" in families and usable(a, b)}
    joint = {f"{a}+{b}": name for a, b, name in JOINT_MEASURES if "entropy" in families and usable(a, b)}
    return stats, values, keys, joint


def _count(df: DataFrame, by: Sequence[str], singles: Sequence[str], pairs: Sequence[str], scopes=None) -> DataFrame:
    split = [tuple(p.split("+")) for p in pairs]
    names = sorted({*singles, *[n for p in split for n in p]})
    columns = {n: DERIVED[n][1]() if n in DERIVED else F.col(n) for n in names}
    return frequency.tagged_counts(df, by, columns, singles, split, scopes)


def counted_features(
    df: DataFrame, by: Sequence[str], families: Sequence[str], parts: Sequence[str] = ("fields", "pairs"), skip: Callable[[str, str], bool] | None = None
) -> DataFrame | None:
    """Counts, frequencies and entropies of single fields and of pairs of fields, from one scan.

    ``correlation``: rows and distinct values per user, process and address, averaged over these
    keys. ``entropy``: also joint entropies; rows with a null in either part do not count. ``skip`` leaves out
    measures by family and name.
    """
    plan = _planned(df.columns, families, parts)
    return None if plan is None else _described(plan.count(df, by), by, plan, skip)


class _Plan(NamedTuple):
    """Measures on the counts of one scan."""

    stats: list
    values: list
    keys: dict
    joint: dict
    families: tuple[str, ...]

    @property
    def singles(self) -> list[str]:
        return sorted({m[1] for m in (*self.stats, *self.values)})

    @property
    def pairs(self) -> list[str]:
        return sorted({*self.keys, *self.joint})

    def count(self, df: DataFrame, by: Sequence[str], scopes=None) -> DataFrame:
        return _count(df, by, self.singles, self.pairs, scopes)

    def static_names(self) -> list[tuple[str, str]]:
        """(family, feature) of the measures whose names are known beforehand."""
        per_key = [("correlation", f"{form}_{word}{name}") for name in self.keys.values() for form in ("avg", "max", "min") for word in ("", "unique_")]
        return [(m[0], m[3]) for m in self.stats] + per_key + [("entropy", name) for name in self.joint.values()]


def _planned(columns: Sequence[str], families: Sequence[str], parts: Sequence[str] = ("fields", "pairs")) -> _Plan | None:
    stats, values, keys, joint = _chosen(columns, families)
    if "fields" not in parts:
        stats, values = [], []
    if "pairs" not in parts:
        keys, joint = {}, {}
    plan = _Plan(stats, values, keys, joint, tuple(families))
    return plan if plan.singles or plan.pairs else None


def _described(counts: DataFrame, by: Sequence[str], plan: _Plan, skip: Callable[[str, str], bool] | None = None) -> DataFrame:
    """The plan's measures as (by, family, feature, value). A row of statistics yields only the measures of its own tag."""
    stats = frequency.tagged_stats(counts, by, sorted({m[1] for m in plan.values}), list(plan.keys), list(plan.joint))
    cells: dict[tuple[str, str], list[tuple[str, str, str]]] = {}
    for family, name, column, feature in plan.stats:
        cells.setdefault(("field", name), []).append((family, f"'{feature}'", column))
    for family, name, pre, post in plan.values:
        cells.setdefault(("value", name), []).append((family, f"concat('{pre}', label, '{post}')", "rows"))
    for tag, name in plan.keys.items():
        for kind, word in (("rows", ""), ("distinct", "unique_")):
            cells.setdefault(("keys", tag), []).extend(("correlation", f"'{form}_{word}{name}'", f"{kind}_{form}") for form in ("avg", "max", "min"))
    for tag, name in plan.joint.items():
        cells.setdefault(("joint", tag), []).append(("entropy", f"'{name}'", "entropy_smoothed"))
    branches = []
    for (view, tag), own in cells.items():
        kept = [c for c in own if skip is None or not skip(c[0], c[1].strip("'"))]
        condition = f"tag = '{tag}' AND " + {"field": "view = 'field' AND label IS NULL", "value": "view = 'field' AND label IS NOT NULL"}.get(view, f"view = '{view}'")
        rows = ", ".join(f"struct('{family}' AS family, {name} AS feature, CAST({column} AS DOUBLE) AS value)" for family, name, column in kept)
        if kept:
            branches.append(f"WHEN {condition} THEN array({rows})")
    if not branches:
        return stats.where("false").select(*by, F.lit("").alias("family"), F.lit("").alias("feature"), F.lit(0.0).alias("value"))
    return stats.select(*by, F.expr(f"inline(CASE {' '.join(branches)} END)"))


def field_features(df: DataFrame, by: Sequence[str], families: Sequence[str]) -> DataFrame | None:
    """``counted_features`` of single fields only."""
    return counted_features(df, by, families, ("fields",))


def pair_features(df: DataFrame, by: Sequence[str], families: Sequence[str]) -> DataFrame | None:
    """``counted_features`` of pairs of fields only."""
    return counted_features(df, by, families, ("pairs",))


def _aggregates(columns: Sequence[str], families: Sequence[str]) -> list[tuple[str, str, Callable[[str], Column]]]:
    return [(family, name, build) for family, name, needs, build in AGGREGATES if family in families and all(c in columns for c in needs)]


def aggregate_features(
    df: DataFrame, by: Sequence[str], families: Sequence[str], failed_login: str = "failed_login"
) -> DataFrame | None:
    """Sums, means and filtered counts, from one aggregation."""
    wanted = _aggregates(df.columns, families)
    if not wanted:
        return None
    table = df.groupBy(*by).agg(*[build(failed_login).alias(name) for _, name, build in wanted])
    return _long(table, by, [Measure(family, f"'{name}'", name) for family, name, _ in wanted])


def sequence_features(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str] = ("timestamp", "event_id"),
    kinds: Sequence[str] = ("event", "command", "gap"),
) -> DataFrame | None:
    """Steps between neighbouring events, from one ordered pass.

    Counts of each ``a->b`` step of event types and of commands with the entropy of these counts,
    and the mean, largest, smallest and sample deviation of the seconds in between.
    """
    source = {"event": "event_type", "command": "command"}
    values = {k: F.col(source[k]) for k in kinds if k in source and source[k] in df.columns}
    gaps = "gap" in kinds
    if not values and not gaps:
        return None
    counts = ordered.sequence_counts(df, by, order, values, "timestamp" if gaps else None)
    # The gap row has no value to count; its columns pass through the statistics of the steps.
    carried = ("gaps", "s", "q", "hi", "lo")
    gaps_only = F.when(F.col("kind") == "gap", F.col("n")).alias("gaps")
    freq = counts.select(
        *by, F.col("kind").alias("field"), F.col("transition").alias("value"), "n", gaps_only, *carried[1:]
    )
    if values:
        stats = frequency.field_stats(freq, by, list(values), carried)
    else:
        nothing = F.lit(None).cast("double")
        stats = freq.select("*", nothing.alias("rows"), nothing.alias("entropy_smoothed"))
    measured = stats.select("*", *[c.alias(name) for name, c in ordered.gap_measures(F.col("gaps")).items()])
    measures = [
        Measure("sequence", "CASE WHEN field <> 'gap' AND value IS NOT NULL THEN concat(field, '_transition_', value) END", "rows"),
        Measure("sequence", "CASE WHEN field <> 'gap' AND value IS NULL THEN concat(field, '_transition_entropy') END", "entropy_smoothed"),
    ]
    if gaps:
        measures += [
            Measure("sequence", f"CASE WHEN field = 'gap' THEN '{short}_time_interval' END", f"gap_{form}")
            for form, short in (("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "std"))
        ]
    return _long(measured, by, measures)


def tfidf_features(df: DataFrame, by: Sequence[str], counts: DataFrame | None = None, **options) -> DataFrame | None:
    """``command_tfidf_{i}``: mean TF-IDF weight of the i-th kept term. ``counts`` may hold the commands counted already."""
    if "command" not in df.columns:
        return None
    if counts is None:
        texts = tfidf.text_counts(df, by, F.col("command"))
    else:
        texts = tfidf.text_counts(counts.where("tag = 'command'"), by, F.col("a"), F.col("n"))
    return _long(tfidf.mean_tfidf_of(texts, by, **options), by, [Measure("text", "concat('command_tfidf_', i)", "weight")])


def extract(
    df: DataFrame,
    by: Sequence[str],
    families: Sequence[str] = BASIC,
    failed_login: str = "failed_login",
    merged: bool = False,
    **tfidf_options,
) -> DataFrame:
    """All features of the chosen families as (by, family, feature, value).

    Fields and pairs share a scan, plain aggregates have one, and so have sequences; terms are
    weighted from the counted commands, which are written to a table for that. Within one family a name occurs
    once; across families see ``merge_features``. With ``merged`` names are unique at once, as that function
    makes them: which family gives a name is settled before anything is computed.
    """
    unknown = sorted(set(families) - set(FAMILIES))
    if unknown:
        raise ValueError(f"unknown feature families: {', '.join(unknown)}")
    plan = _planned(df.columns, families)
    skip = _losers(plan, df.columns, families) if merged else None
    tables, counts = [], None
    if plan is not None:
        counts = plan.count(df, by)
        if "text" in families and "command" in plan.singles:
            counts = settle(counts)
        tables.append(_described(counts, by, plan, skip))
    tables.append(aggregate_features(df, by, families, failed_login))
    if "text" in families:
        known = counts if plan is not None and "command" in plan.singles else None
        tables.append(tfidf_features(df, by, known, **tfidf_options))
    if "sequence" in families:
        tables.append(sequence_features(df, by))
    long = reduce(DataFrame.unionByName, [t for t in tables if t is not None])
    if not merged:
        return long
    # A value may be called like a measure of a later family: the measure wins.
    taken = [(family, name) for family, name in _static(plan, df.columns, families)]
    for family, _, pre, post in plan.values if plan else []:
        later = [n for f, n in taken if FAMILIES.index(f) > FAMILIES.index(family) and n.startswith(pre) and n.endswith(post)]
        if later:
            long = long.where(~((F.col("family") == family) & F.col("feature").isin(later)))
    return long.select(*by, "feature", "value")


def _static(plan: _Plan | None, columns: Sequence[str], families: Sequence[str]) -> list[tuple[str, str]]:
    """(family, name) of all measures with a known name."""
    return (plan.static_names() if plan else []) + [(family, name) for family, name, _ in _aggregates(columns, families)]


def _losers(plan: _Plan | None, columns: Sequence[str], families: Sequence[str]) -> Callable[[str, str], bool]:
    """Whether a later family gives the same name."""
    last: dict[str, str] = {}
    for family, name in sorted(_static(plan, columns, families), key=lambda m: FAMILIES.index(m[0])):
        last[name] = family
    return lambda family, name: last.get(name, family) != family


def merge_features(long: DataFrame, by: Sequence[str], families: Sequence[str] = FAMILIES) -> DataFrame:
    """(by, feature, value) with one row per name: the family that comes last wins."""
    rank = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family"))
    return long.groupBy(*by, "feature").agg(F.max_by("value", rank).alias("value"))


def feature_names(long: DataFrame) -> DataFrame:
    """Every feature name that occurs."""
    return long.select("feature").distinct()


def feature_matrix(
    long: DataFrame, by: Sequence[str], features: Sequence[str], strict: bool = False
) -> DataFrame:
    """(by, one DOUBLE column per name in ``features``, in that order), nulls and NaN as 0.

    Other features drop out. ``strict`` raises when a name occurs in no row at all.
    """
    if strict:
        present = {r[0] for r in long.where(F.col("feature").isin(list(features))).select("feature").distinct().collect()}
        absent = [f for f in features if f not in present]
        if absent:
            raise ValueError(f"features not found: {', '.join(absent)}")
    wide = (
        long.where(F.col("feature").isin(list(features)))
        .groupBy(*by)
        .pivot("feature", list(features))
        .agg(F.first("value"))
    )
    return wide.select(
        *by, *[F.coalesce(F.nanvl(F.col(f"`{f}`"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features]
    )


def merged_matrix(long: DataFrame, by: Sequence[str], features: Sequence[str], families: Sequence[str] = FAMILIES) -> DataFrame:
    """``feature_matrix`` of ``merge_features`` from one aggregation: the names are known, so each is a conditional aggregate."""
    rank = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family"))

    def cell(name: str) -> Column:
        own = F.col("feature") == name
        return F.max_by(F.when(own, F.col("value")), F.when(own, rank)).alias(name)

    wide = long.where(F.col("feature").isin(list(features))).groupBy(*by).agg(*[cell(f) for f in features])
    return wide.select(*by, *[_no_gaps(f) for f in features])


def _no_gaps(name: str) -> Column:
    value = F.col(f"`{name}`").cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias(name)


def wide_features(
    df: DataFrame, by: Sequence[str], names: Sequence[str], families: Sequence[str] = BASIC, failed_login: str = "failed_login", **tfidf_options
) -> DataFrame:
    """``merged_matrix`` of ``extract``, straight from the counts where all names are measures of fields or aggregates.

    Counts of values and plain aggregates meet in one last aggregation, one row per scope: there is no long
    form. Fields that no name needs are not counted. Names that no family gives are 0.
    """
    plan = _planned(df.columns, families)
    plain = {name: build for _, name, build in _aggregates(df.columns, families)}
    winners: dict[str, tuple[str, str, str]] = {}
    for m in sorted(plan.stats if plan else [], key=lambda m: FAMILIES.index(m[0])):
        winners[m[3]] = m
    fixed = {n for _, n in _static(plan, df.columns, families)}
    dynamic = [(m[2], m[3]) for m in (plan.values if plan else [])]
    others = [n for n in names if n not in fixed and any(n.startswith(pre) and n.endswith(post) for pre, post in dynamic)]
    if others or any(n in fixed and n not in winners and n not in plain for n in names) or set(families) & {"text", "sequence"}:
        return merged_matrix(extract(df, by, families, failed_login, **tfidf_options), by, names, families)
    counted = {n: winners[n] for n in names if n in winners}
    summed = {n: plain[n] for n in names if n in plain}
    fields = sorted({m[1] for m in counted.values()})
    tables = []
    if fields:
        sizes = frequency.count_sizes(_count(df, by, fields, []), by)
        tables.append(sizes.select(*by, "tag", "size", "m"))
    if summed or not fields:
        tables.append(df.groupBy(*by).agg(F.lit(None).alias("tag"), *[build(failed_login).cast("double").alias(f"p:{n}") for n, build in summed.items()]))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    lists = [frequency.listed_sizes(F.col("tag") == f).alias(f"s:{f}") for f in fields]
    sums = [F.max(f"`p:{n}`").alias(f"p:{n}") for n in summed]
    one = rows.groupBy(*by).agg(*lists, *sums) if lists or sums else rows.drop("tag")
    # A list's total is a column of its own, or every element would add it up again.
    one = one.withColumns({f"t:{f}": frequency.sizes_total(F.col(f"`s:{f}`")) for f in fields})
    cells = [
        frequency.size_measures(F.col(f"`s:{counted[n][1]}`"), F.col(f"`t:{counted[n][1]}`"))[counted[n][2]].alias(n)
        if n in counted
        else (F.col(f"`p:{n}`") if n in summed else F.lit(0.0)).alias(n)
        for n in names
    ]
    return one.select(*by, *cells).select(*by, *[_no_gaps(n) for n in names])


def windowed_features(
    df: DataFrame, widths: dict[str, int], failed_login: str = "failed_login", ts: str = "timestamp"
) -> DataFrame:
    """(family, scope, feature, value) of basic families, each with a window width of its own, from one scan per pass.

    Every field is counted in windows as wide as the greatest common divisor of the widths that its families have;
    where these differ, the counts are added up to each of the wider windows, so no event is read again.
    Plain aggregates are computed for all widths in one pass.
    """
    families = list(widths)
    plan = _planned(df.columns, families)
    tables = []
    if plan is not None:
        wanted: dict[str, set[int]] = {}
        for family, name, *_ in (*plan.stats, *plan.values):
            wanted.setdefault(name, set()).add(widths[family])
        for pair, names in (*plan.keys.items(), *plan.joint.items()):
            wanted.setdefault(pair, set()).update(widths[f] for f in ("correlation", "entropy") if f in widths)
        base = {tag: reduce(gcd, own) for tag, own in wanted.items()}
        counts = _count(df, [], plan.singles, plan.pairs, {tag: {w: floor_time(F.col(ts), w)} for tag, w in base.items()})
        if any(len(own) > 1 for own in wanted.values()):
            ups = {tag: {w: floor_time(F.col("scope"), w) for w in sorted(own)} for tag, own in wanted.items()}
            counts = frequency.rolled_up(counts, ups)
        tables.append(_described(counts, ["width", "scope"], plan))
    aggregates = _aggregates(df.columns, families)
    if aggregates:
        own = sorted({widths[family] for family, _, _ in aggregates})
        starts = F.array(*[F.struct(F.lit(w).alias("width"), floor_time(F.col(ts), w).alias("scope")) for w in own])
        table = df.select("*", F.inline(starts)).groupBy("width", "scope").agg(*[build(failed_login).alias(name) for _, name, build in aggregates])
        tables.append(_long(table, ["width", "scope"], [Measure(family, f"'{name}'", name) for family, name, _ in aggregates]))
    long = reduce(DataFrame.unionByName, tables)
    # A field's row holds the measures of all its families; each counts at its own width.
    right = reduce(lambda a, b: a | b, [(F.col("family") == f) & (F.col("width") == w) for f, w in widths.items()])
    return long.where(right).select("family", "scope", "feature", "value")
