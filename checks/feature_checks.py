"""Feature families per hour, each against its plain definition in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.sample import DAY, EV, FAILED_LOGIN, SC, events, scoped, table
from eventlens.functions.text import file_extension, path_depth, special_char_ratio
from eventlens.functions.time import time_parts
from eventlens.operators import features, frequency, ordered, tfidf
from eventlens.plans.detection import family_windows

BY = ["scope"]

# Sums next to zero may round to -0.0, hence the + 0.0 below.
# Plain definitions over (scope, v, n, p); the null group has n = 0 and does not count.
DISTINCT = "CAST(count(v) AS DOUBLE)"
LARGEST = "CAST(max(n) FILTER (v IS NOT NULL) AS DOUBLE)"
MEAN = "avg(n) FILTER (v IS NOT NULL)"
ENTROPY = "coalesce(0 - sum(p * log2(p)) FILTER (v IS NOT NULL), 0)"
SMOOTHED = "coalesce(0 - sum(p * log2(p + 1e-10)) FILTER (v IS NOT NULL), 0)"


def counts(field: str, scope: str = "scope", source: str = "sc") -> str:
    return (
        f"(SELECT *, n / nullif(sum(n) OVER (PARTITION BY scope), 0) AS p FROM "
        f"(SELECT {scope} AS scope, {field} AS v, count({field}) AS n FROM {source} GROUP BY 1, 2))"
    )


def stat(field: str, measure: str, name: str) -> str:
    return f"SELECT scope, '{name}' AS feature, round({measure}, 6) + 0.0 AS value FROM {counts(field)} GROUP BY scope"


def agg(measure: str, name: str) -> str:
    return f"SELECT scope, '{name}' AS feature, round(CAST({measure} AS DOUBLE), 6) AS value FROM sc GROUP BY scope"


def per_value(field: str, name: str) -> str:
    return (
        f"SELECT scope, {name} AS feature, CAST(count(*) AS DOUBLE) AS value FROM sc "
        f"WHERE {field} IS NOT NULL GROUP BY scope, {field}"
    )


def union(*parts: str, ctes: str = SC) -> str:
    return f"WITH {ctes}\n" + "\nUNION ALL\n".join(parts)


def _family(*names: str):
    def run(spark, sf):
        long = features.extract(scoped(spark, sf), BY, names, FAILED_LOGIN)
        return rounded(long.select("scope", "feature", "value"))

    return run


EVENT_TYPE = [per_value("event_type", "concat('event_type_', event_type)")]
IP = [
    stat(f, m, f"{f}_{s}")
    for f in ("source_ip", "destination_ip")
    for m, s in ((DISTINCT, "count"), (LARGEST, "max_frequency"), (MEAN, "mean_frequency"))
]
USER = [
    stat("username", DISTINCT, "user_count"),
    stat("username", LARGEST, "user_max_activity"),
    stat("username", MEAN, "user_mean_activity"),
    agg("count(*) FILTER (event_type = 'error')", "failed_login_count"),
    stat("command", DISTINCT, "unique_commands"),
    stat("command", ENTROPY, "command_entropy"),
    stat("file_path", DISTINCT, "unique_files_accessed"),
    stat("file_path", ENTROPY, "file_access_entropy"),
]
PROCESS = [
    stat("process_name", DISTINCT, "process_count"),
    stat("process_name", LARGEST, "process_max_frequency"),
    stat("process_name", MEAN, "process_mean_frequency"),
]
ALERT = [
    per_value("alert_level", "concat('alert_level_', alert_level, '_count')"),
    agg("count(*) FILTER (alert_level >= 12)", "high_severity_count"),
]
NETWORK = [
    agg("sum(packet_count)", "total_packets"),
    agg("avg(packet_count)", "avg_packets_per_connection"),
    agg("sum(byte_count)", "total_bytes"),
    agg("avg(byte_count)", "avg_bytes_per_connection"),
    stat("connection_id", DISTINCT, "unique_connections"),
    per_value("protocol", "concat('protocol_', protocol, '_count')"),
    stat("protocol", ENTROPY, "protocol_entropy"),
]
SYSCALL = [
    stat("syscall", DISTINCT, "unique_syscalls"),
    stat("syscall", ENTROPY, "syscall_entropy"),
    stat("parent_process", DISTINCT, "unique_parent_processes"),
    stat("parent_process", ENTROPY, "process_creation_entropy"),
]
CMDLINE = [
    stat("command", DISTINCT, "unique_commands"),
    stat("command", ENTROPY, "command_entropy"),
    stat("arguments", DISTINCT, "unique_argument_patterns"),
    stat("arguments", ENTROPY, "argument_entropy"),
    agg("avg(execution_time)", "avg_execution_time"),
    agg("stddev_samp(execution_time)", "std_execution_time"),
]
SINGLE_ENTROPIES = [
    stat(f, SMOOTHED, f"{f}_entropy")
    for f in (
        "event_type", "username", "process_name", "source_ip",
        "destination_ip", "alert_level", "command", "file_path",
    )
]


def joint(a: str, b: str, name: str) -> str:
    return (
        f"SELECT scope, '{name}' AS feature, round(0 - sum(p * log2(p + 1e-10)), 6) + 0.0 AS value FROM "
        f"(SELECT scope, n / sum(n) OVER (PARTITION BY scope) AS p FROM (SELECT scope, count(*) AS n FROM sc "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY scope, {a}, {b})) GROUP BY scope"
    )


JOINT = [
    joint("username", "command", "username_command_joint_entropy"),
    joint("source_ip", "destination_ip", "ip_joint_entropy"),
]


def per_key(key: str, value: str, noun: str, who: str) -> list[str]:
    groups = f"(SELECT scope, count({value}) AS r, count(DISTINCT {value}) AS d FROM sc WHERE {key} IS NOT NULL GROUP BY scope, {key})"
    return [
        f"SELECT scope, '{f}_{word}{noun}_per_{who}' AS feature, round(CAST({f}({c}) AS DOUBLE), 6) AS value FROM {groups} GROUP BY scope"
        for c, word in (("r", ""), ("d", "unique_"))
        for f in ("avg", "max", "min")
    ]


KEYS = [
    *per_key("username", "command", "commands", "user"),
    *per_key("username", "file_path", "files", "user"),
    *per_key("process_name", "command", "commands", "process"),
    *per_key("source_ip", "command", "commands", "ip"),
]

RATIO = "coalesce(length(regexp_replace({0}, '[a-zA-Z0-9\\s]', '', 'g')) / nullif(length({0}), 0), 0)"
EXTENSION = "CASE WHEN contains(file_path, '.') THEN string_split(file_path, '.')[-1] ELSE 'no_extension' END"
LENGTHS = [agg(f"{f}(length(command))", f"command_{f}_length") for f in ("avg", "max", "min")]
RATIOS = [agg(f"avg({RATIO.format(c)})", f"{c}_special_char_ratio") for c in ("command", "username")]
PATHS = [
    agg("avg(len(string_split(coalesce(file_path, 'None'), '/')))", "path_avg_depth"),
    stat(f"({EXTENSION})", SMOOTHED, "file_extension_entropy"),
]
TEXT_ENTROPIES = [stat("command", SMOOTHED, "command_entropy"), stat("username", SMOOTHED, "username_entropy")]
CALENDAR = [
    stat("hour(timestamp)", SMOOTHED, "hour_entropy"),
    stat("isodow(timestamp)", SMOOTHED, "day_of_week_entropy"),
]

query("event_type_counts", union(*EVENT_TYPE))(_family("event_type"))
query("ip_features", union(*IP))(_family("source_ip", "destination_ip"))
query("user_features", union(*USER))(_family("user"))
query("process_features", union(*PROCESS))(_family("process"))
query("alert_features", union(*ALERT))(_family("alert"))
query("network_features", union(*NETWORK))(_family("network"))
query("syscall_features", union(*SYSCALL))(_family("syscall"))
query("cmdline_features", union(*CMDLINE))(_family("cmdline"))


def _only(build, *wanted: str):
    def run(spark, sf):
        long = build(scoped(spark, sf))
        if wanted:
            long = long.where(F.col("feature").isin(list(wanted)))
        return rounded(long.select("scope", "feature", "value"))

    return run


@query(
    "entropy_basic",
    f"WITH {SC} SELECT scope, CAST(count(v) AS BIGINT) AS values, round({ENTROPY}, 6) + 0.0 AS entropy "
    f"FROM {counts('command')} GROUP BY scope",
)
def _(spark, sf):
    freq = frequency.frequencies(scoped(spark, sf), BY, {"command": F.col("command")})
    return rounded(frequency.field_stats(freq, BY).select("scope", F.col("distinct").alias("values"), "entropy"))


@query("entropy_smoothed", f"WITH {SC} SELECT scope, round({SMOOTHED}, 6) + 0.0 AS entropy FROM {counts('command')} GROUP BY scope")
def _(spark, sf):
    freq = frequency.frequencies(scoped(spark, sf), BY, {"command": F.col("command")})
    return rounded(frequency.field_stats(freq, BY).select("scope", F.col("entropy_smoothed").alias("entropy")))


query("field_entropies", union(*SINGLE_ENTROPIES))(
    _only(lambda df: features.field_features(df, BY, ["entropy"]))
)
query("joint_entropies", union(*JOINT))(_only(lambda df: features.pair_features(df, BY, ["entropy"])))
query("per_key_stats", union(*KEYS))(_only(lambda df: features.pair_features(df, BY, ["correlation"])))
query("text_features", union(*LENGTHS, *RATIOS, *TEXT_ENTROPIES))(
    _only(
        lambda df: features.aggregate_features(df, BY, ["text"]).unionByName(features.field_features(df, BY, ["text"])),
        "command_avg_length",
        "command_max_length",
        "command_min_length",
        "command_special_char_ratio",
        "username_special_char_ratio",
        "command_entropy",
        "username_entropy",
    )
)
query("path_features", union(*PATHS))(
    _only(
        lambda df: features.aggregate_features(df, BY, ["text"]).unionByName(features.field_features(df, BY, ["text"])),
        "path_avg_depth",
        "file_extension_entropy",
    )
)
query("calendar_entropy", union(*CALENDAR, ctes=DAY))(
    lambda spark, sf: rounded(
        features.field_features(scoped(spark, sf, 86400), BY, ["sequence"]).select("scope", "feature", "value")
    )
)


@query(
    "time_parts",
    f"WITH {EV} SELECT event_id, timestamp, CAST(hour(timestamp) AS INTEGER) AS hour, "
    "CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week FROM ev",
)
def _(spark, sf):
    df = events(spark, sf)
    return df.select("event_id", "timestamp", *[c.alias(n) for n, c in time_parts(F.col("timestamp")).items()])


def steps(field: str, partition: str = "PARTITION BY scope") -> str:
    return (
        f"(SELECT scope, concat(a, '->', b) AS v FROM (SELECT scope, a, lead(a) OVER ({partition} ORDER BY timestamp, event_id) AS b "
        f"FROM (SELECT *, coalesce(CAST({field} AS VARCHAR), 'None') AS a FROM sc)) WHERE b IS NOT NULL)"
    )


def transitions(field: str, kind: str) -> list[str]:
    return [
        f"SELECT scope, concat('{kind}_transition_', v) AS feature, CAST(count(*) AS DOUBLE) AS value FROM {steps(field)} GROUP BY scope, v",
        f"SELECT scope, '{kind}_transition_entropy' AS feature, round({SMOOTHED}, 6) + 0.0 AS value FROM "
        f"{counts('v', source=steps(field))} GROUP BY scope",
    ]


# Sums of whole microseconds are exact, and so are these quotients: nothing to round but the deviation.
GAPS = [
    f"SELECT scope, '{short}_time_interval' AS feature, {f} AS value FROM "
    "(SELECT scope, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY scope ORDER BY timestamp, event_id)) AS gap FROM sc) "
    "GROUP BY scope"
    for short, f in (
        ("avg", "CAST(sum(gap) AS DOUBLE) / count(gap) / 1e6"),
        ("max", "max(gap) / 1e6"),
        ("min", "min(gap) / 1e6"),
        ("std", "round(stddev_samp(gap / 1e6), 6)"),
    )
]



def _rounded_features(long):
    exact = F.col("feature").isin(["avg_time_interval", "max_time_interval", "min_time_interval"])
    value = F.when(exact, F.col("value")).otherwise(F.round("value", 6))
    return long.select("scope", "feature", value.alias("value"))


query("event_transitions", union(*transitions("event_type", "event")))(
    _only(lambda df: features.sequence_features(df, BY, kinds=["event"]))
)
query("command_transitions", union(*transitions("command", "command")))(
    _only(lambda df: features.sequence_features(df, BY, kinds=["command"]))
)


@query("time_gaps", union(*GAPS))
def _(spark, sf):
    return _rounded_features(features.sequence_features(scoped(spark, sf), BY, kinds=["gap"]))


@query(
    "event_transitions_global",
    f"WITH {EV} SELECT concat(event_type, '->', b) AS transition, count(*) AS n FROM "
    "(SELECT event_type, lead(event_type) OVER (ORDER BY timestamp, event_id) AS b FROM ev) WHERE b IS NOT NULL GROUP BY 1",
)
def _(spark, sf):
    counted = ordered.transition_counts(
        events(spark, sf), [], ["timestamp", "event_id"], {"event": F.col("event_type")}
    )
    return counted.select("transition", "n")


@query(
    "rolling_entropy",
    f"""WITH {EV},
w AS (SELECT username, timestamp, event_id, event_type,
             list(event_type) OVER (PARTITION BY username ORDER BY timestamp, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS l
      FROM ev),
c AS (SELECT *, len(list_filter(l, lambda x: x = 'signup')) AS n1, len(list_filter(l, lambda x: x = 'error')) AS n2,
             len(list_filter(l, lambda x: x = 'click')) AS n3, len(list_filter(l, lambda x: x = 'view')) AS n4,
             len(list_filter(l, lambda x: x = 'purchase')) AS n5, CAST(len(l) AS DOUBLE) AS t FROM w),
e AS (SELECT username, timestamp, event_id, event_type,
             0 - (CASE WHEN n1 > 0 THEN n1 / t * log2(n1 / t) ELSE 0 END + CASE WHEN n2 > 0 THEN n2 / t * log2(n2 / t) ELSE 0 END
                + CASE WHEN n3 > 0 THEN n3 / t * log2(n3 / t) ELSE 0 END + CASE WHEN n4 > 0 THEN n4 / t * log2(n4 / t) ELSE 0 END
                + CASE WHEN n5 > 0 THEN n5 / t * log2(n5 / t) ELSE 0 END) AS h FROM c)
SELECT username, timestamp, event_id, event_type, round(h, 6) AS rolling_entropy FROM e WHERE h >= 0.1""",
)
def _(spark, sf):
    return rounded(ordered.rolling_entropy(events(spark, sf), ["username"], ["timestamp", "event_id"], "event_type"))


def tfidf_sql(bigrams: bool) -> str:
    pairs = "UNION ALL SELECT scope, event_id, w[i] || ' ' || w[i + 1] AS term FROM (SELECT *, unnest(range(1, len(w))) AS i FROM tok)"
    return f"""WITH {DAY},
tok AS (SELECT scope, event_id, regexp_extract_all(lower(coalesce(command, '')), '\\b\\w\\w+\\b') AS w FROM sc),
docs AS (SELECT scope, count(*) AS nd FROM sc GROUP BY scope),
tm AS (SELECT scope, event_id, unnest(w) AS term FROM tok {pairs if bigrams else ''}),
tf AS (SELECT scope, event_id, term, count(*) AS tf FROM tm GROUP BY ALL),
dfr AS (SELECT scope, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL),
cut AS (SELECT * FROM dfr QUALIFY row_number() OVER (PARTITION BY scope ORDER BY total DESC, term) <= 100),
voc AS (SELECT scope, term, row_number() OVER (PARTITION BY scope ORDER BY term) - 1 AS i, nd,
               ln((1 + nd) / (1 + df)) + 1 AS idf FROM cut JOIN docs USING (scope)),
wt AS (SELECT scope, event_id, i, term, nd, tf * idf AS w FROM tf JOIN voc USING (scope, term)),
un AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY scope, event_id)) AS u FROM wt)
SELECT scope, CAST(i AS INTEGER) AS i, term, round(sum(u) / any_value(nd), 6) AS weight FROM un GROUP BY scope, i, term"""


@query("tfidf_command", tfidf_sql(False))
def _(spark, sf):
    return rounded(tfidf.mean_tfidf(scoped(spark, sf, 86400), BY, F.col("command")))


@query("tfidf_bigrams", tfidf_sql(True))
def _(spark, sf):
    return rounded(tfidf.mean_tfidf(scoped(spark, sf, 86400), BY, F.col("command"), ngrams=(1, 2)))


DOCUMENTS = """WITH tok AS (SELECT lang, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}_]{2,}') AS w FROM documents),
docs AS (SELECT lang, count(*) AS nd FROM documents GROUP BY lang),
tf AS (SELECT lang, doc_id, term, count(*) AS tf FROM (SELECT lang, doc_id, unnest(w) AS term FROM tok) GROUP BY ALL),
dfr AS (SELECT lang, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL),
cut AS (SELECT * FROM dfr QUALIFY row_number() OVER (PARTITION BY lang ORDER BY total DESC, term) <= 100),
voc AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY term) - 1 AS i, nd,
               ln((1 + nd) / (1 + df)) + 1 AS idf FROM cut JOIN docs USING (lang)),
wt AS (SELECT lang, doc_id, i, term, nd, tf * idf AS w FROM tf JOIN voc USING (lang, term)),
un AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY lang, doc_id)) AS u FROM wt)
SELECT lang, CAST(i AS INTEGER) AS i, term, round(sum(u) / any_value(nd), 6) AS weight FROM un GROUP BY lang, i, term"""


# The default English stop words that are plain words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now would could cannot ought
""".split()
_STOPPED = DOCUMENTS.replace("SELECT lang, doc_id, unnest(w) AS term FROM tok", "SELECT * FROM (SELECT lang, doc_id, unnest(w) AS term FROM tok) WHERE term NOT IN ("
                             + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")")


@query("tfidf_stop_words", _STOPPED)
def _(spark, sf):
    return rounded(tfidf.mean_tfidf(table(spark, sf, "documents"), ["lang"], F.col("text")))


@query("tfidf_documents", DOCUMENTS)
def _(spark, sf):
    texts = table(spark, sf, "documents")
    return rounded(tfidf.mean_tfidf(texts, ["lang"], F.col("text"), stop_words=[]))


_URL_RATIO = RATIO.format("url")


@query(
    "url_measures",
    f"SELECT page_id, CAST(len(string_split(url, '/')) AS INTEGER) AS depth, "
    f"CASE WHEN contains(url, '.') THEN string_split(url, '.')[-1] ELSE 'no_extension' END AS extension, "
    f"round({_URL_RATIO}, 6) AS special_char_ratio FROM pages",
)
def _(spark, sf):
    url = F.col("url")
    return rounded(
        table(spark, sf, "pages").select(
            "page_id",
            path_depth(url).alias("depth"),
            file_extension(url).alias("extension"),
            special_char_ratio(url).alias("special_char_ratio"),
        )
    )


@query(
    "role_transitions",
    "SELECT conv_id, concat(role, '->', b) AS transition, count(*) AS n FROM "
    "(SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL GROUP BY ALL",
)
def _(spark, sf):
    turns = table(spark, sf, "conversations")
    counted = ordered.transition_counts(turns, ["conv_id"], ["turn"], {"role": F.col("role")})
    return counted.select("conv_id", "transition", "n")


TFIDF_FEATURES = tfidf_sql(False)
ALL_PARTS = {
    "basic": [*EVENT_TYPE, *IP, *USER, *PROCESS, *ALERT, *NETWORK, *SYSCALL, *CMDLINE],
    "advanced": [
        *LENGTHS, *RATIOS, *TEXT_ENTROPIES, *PATHS, *CALENDAR, *GAPS, *KEYS, *SINGLE_ENTROPIES, *JOINT,
        *transitions("event_type", "event"), *transitions("command", "command"),
    ],
}


def merged_sql() -> str:
    """All features per day; where names repeat, the advanced value replaces the basic one."""
    advanced = "\nUNION ALL\n".join(f"SELECT 2 AS level, * FROM ({p})" for p in ALL_PARTS["advanced"])
    basic = "\nUNION ALL\n".join(f"SELECT 1 AS level, * FROM ({p})" for p in ALL_PARTS["basic"])
    tf = f"SELECT 2 AS level, scope, concat('command_tfidf_', i) AS feature, weight AS value FROM ({TFIDF_FEATURES})"
    return (
        f"WITH {DAY},\nlong AS ({basic}\nUNION ALL\n{advanced}\nUNION ALL\n{tf})\n"
        "SELECT scope, feature, max(value) AS value FROM "
        "(SELECT *, max(level) OVER (PARTITION BY scope, feature) AS best FROM long) WHERE level = best GROUP BY scope, feature"
    )


@query("features_all", merged_sql())
def _(spark, sf):
    return _rounded_features(features.extract(scoped(spark, sf, 86400), BY, features.FAMILIES, FAILED_LOGIN, merged=True))


@query(
    "nan_execution_time",
    f"WITH {SC} SELECT scope, round(avg(execution_time) FILTER (event_id % 11 <> 0), 6) AS mean, "
    "round(stddev_samp(execution_time) FILTER (event_id % 11 <> 0), 6) AS deviation FROM sc GROUP BY scope",
)
def _(spark, sf):
    spoilt = F.when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("execution_time"))
    long = features.extract(scoped(spark, sf).withColumn("execution_time", spoilt), BY, ["cmdline"])
    one = [long.where(F.col("feature") == f"{f}_execution_time").select("scope", F.col("value").alias(n)) for f, n in (("avg", "mean"), ("std", "deviation"))]
    return rounded(one[0].join(one[1], "scope"))


@query(
    "gaps_stretched",
    f"WITH {EV}, g AS (SELECT username, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY username ORDER BY timestamp, event_id)) / 1e6 * 1000 AS gap FROM ev) "
    "SELECT username, count(gap) AS n, round(stddev_samp(gap), 2) AS deviation FROM g GROUP BY username",
)
def _(spark, sf):
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    stretched = events(spark, sf).withColumn("timestamp", origin + (F.col("timestamp") - origin) * 1000)
    gaps = ordered.gap_stats(stretched, ["username"], "timestamp", ["timestamp", "event_id"])
    return gaps.select("username", "n", F.round("std", 2).alias("deviation"))


@query(
    "feature_names",
    "SELECT DISTINCT feature FROM (" + merged_sql() + ")",
)
def _(spark, sf):
    return features.feature_names(features.extract(scoped(spark, sf, 86400), BY, features.FAMILIES, FAILED_LOGIN))


def windows_sql(user: int = 3600, network: int = 300, syscall: int = 60, cmdline: int = 3600) -> str:
    parts = []
    for family, seconds, items in (("user", user, USER), ("network", network, NETWORK), ("syscall", syscall, SYSCALL), ("cmdline", cmdline, CMDLINE)):
        body = "\nUNION ALL\n".join(items)
        scope = f"SELECT time_bucket(INTERVAL '{seconds} seconds', timestamp) AS scope, * FROM ev"
        parts.append(f"SELECT '{family}' AS family, * FROM (WITH sc AS ({scope}) {body})")
    return f"WITH {EV}\n" + "\nUNION ALL\n".join(parts)


@query("family_windows", windows_sql())
def _(spark, sf):
    return rounded(family_windows(events(spark, sf), failed_login=FAILED_LOGIN))


# Commands belong to two families: counted by 20 minutes, and added up to windows of 40 and of 60.
ODD_WINDOWS = {"user": 2400, "network": 600, "syscall": 90, "cmdline": 3600}


@query("family_windows_rolled_up", windows_sql(**ODD_WINDOWS))
def _(spark, sf):
    return rounded(family_windows(events(spark, sf), ODD_WINDOWS, FAILED_LOGIN))
