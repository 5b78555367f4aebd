"""Ordered operators must not care how their rows are cut into chunks."""

import random
from collections import Counter, defaultdict

import pytest
from helpers import START, entropy, frame
from pyspark.sql import functions as F

from eventlens.operators.features import with_scope
from eventlens.operators import evaluation, incidents, ordered

ORDER = ["timestamp", "event_id"]


def skewed(spark, n=600, seed=3):
    """Two thirds of the rows in one scope, many of them at one moment."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        scope = "hot" if i % 3 else rng.choice("abc")
        at = 100 if i % 2 else rng.randint(0, 400)
        rows.append({"event_id": i, "username": scope, "timestamp": at, "event_type": rng.choice("pqr"), "command": rng.choice(["x", None])})
    rng.shuffle(rows)
    return frame(spark, rows), rows


def groups(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["timestamp"], r["event_id"])):
        out[r["username"]].append(r)
    return out


@pytest.fixture(params=[1, 7, 40])
def chunks(request):
    return request.param


def test_hot_scope_is_cut(spark):
    df, _ = skewed(spark)
    per = ordered.range_chunks(df, ["username"], ORDER, 7).where("username = 'hot'").groupBy(ordered.CHUNK).count().collect()
    assert len(per) > 1 and max(r["count"] for r in per) < 200


def test_transitions(spark, chunks):
    df, rows = skewed(spark)
    values = {"event": F.col("event_type"), "command": F.col("command")}
    got = ordered.transition_counts(df, ["username"], ORDER, values, chunks).collect()
    want = Counter()
    for scope, g in groups(rows).items():
        for a, b in zip(g, g[1:]):
            want[scope, "event", f"{a['event_type']}->{b['event_type']}"] += 1
            want[scope, "command", f"{a['command']}->{b['command']}"] += 1
    assert {(r["username"], r["kind"], r["transition"]): r["n"] for r in got} == want


def test_transitions_of_whole_table(spark, chunks):
    df, rows = skewed(spark)
    got = ordered.transition_counts(df, [], ORDER, {"event": F.col("event_type")}, chunks).collect()
    seq = [r["event_type"] for r in sorted(rows, key=lambda r: (r["timestamp"], r["event_id"]))]
    assert {r["transition"]: r["n"] for r in got} == Counter(f"{a}->{b}" for a, b in zip(seq, seq[1:]))


def test_gaps(spark, chunks):
    df, rows = skewed(spark)
    got = {r["username"]: r for r in ordered.gap_stats(df, ["username"], "timestamp", ORDER, chunks).collect()}
    for scope, g in groups(rows).items():
        gaps = [b["timestamp"] - a["timestamp"] for a, b in zip(g, g[1:])]
        mean = sum(gaps) / len(gaps)
        r = got[scope]
        assert (r["n"], r["max"], r["min"]) == (len(gaps), max(gaps), min(gaps))
        assert r["mean"] == pytest.approx(mean)
        assert r["std"] == pytest.approx((sum((x - mean) ** 2 for x in gaps) / (len(gaps) - 1)) ** 0.5)


@pytest.mark.parametrize("window", [5, 50])
def test_rolling_entropy(spark, chunks, window):
    df, rows = skewed(spark)
    got = ordered.rolling_entropy(df, ["username"], ORDER, "event_type", window, 0.1, chunks).collect()
    want = {}
    for g in groups(rows).values():
        for i, r in enumerate(g):
            h = entropy(x["event_type"] for x in g[max(0, i - window + 1) : i + 1])
            if h >= 0.1:
                want[r["event_id"]] = h
    assert {r["event_id"] for r in got} == set(want)
    for r in got:
        assert r["rolling_entropy"] == pytest.approx(want[r["event_id"]])


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.999, 1.0])
def test_exact_quantile(spark, chunks, q):
    rng = random.Random(1)
    values = [float(rng.choice([1, 1, 1, 1, rng.random() * 10])) for _ in range(301)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    row = ordered.exact_quantile(df, "v", q, chunks).first()
    values.sort()
    rank = (len(values) - 1) * q
    low = int(rank)
    high = min(low + 1, len(values) - 1)
    assert row["n"] == 301
    assert row["quantile"] == pytest.approx(values[low] + (values[high] - values[low]) * (rank - low))


def test_roc_auc(spark, chunks):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 1), 0.5 if i % 3 == 0 else round(rng.random(), 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t int, s double")
    got = {r["g"]: r["roc_auc"] for r in evaluation.roc_auc(df, F.col("t"), F.col("s"), ["g"], chunks).collect()}
    for g in "ab":
        pos = [s for x, t, s in rows if x == g and t]
        neg = [s for x, t, s in rows if x == g and not t]
        wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert got[g] == pytest.approx(wins / len(pos) / len(neg))


def test_roc_auc_of_one_class(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "t int, s double")
    assert evaluation.roc_auc(df, F.col("t"), F.col("s")).first()["roc_auc"] is None


def test_event_pages_hold_every_event_in_order(spark, chunks):
    n = 230
    df = frame(spark, [{"timestamp": i // 50, "event_type": "t"} for i in range(n)]).withColumn("score", F.lit(0.95))
    hits = incidents.high_score_events(df)
    pages = incidents.event_pages(hits, 20, chunks).collect()
    assert {p["page"]: len(p["events"]) for p in pages} == {i: 20 if i < 11 else 10 for i in range(12)}
    ids = [e["event_id"] for p in sorted(pages, key=lambda p: p["page"]) for e in p["events"]]
    assert ids == list(range(n))
    assert {p["incident_id"] for p in pages} == {incidents.detect_incidents(df).first()["id"]}
    assert hits.first()["window"] == START


@pytest.mark.parametrize("chunks", [1, 3])
def test_deviation_of_long_gaps_with_small_spread(spark, chunks):
    text = ["2024-01-01 00:00:00", "2024-01-12 13:46:40", "2024-01-24 03:33:20.001", "2024-02-04 17:20:00.001"]
    df = spark.createDataFrame(list(enumerate(text)), "event_id bigint, t string").select("event_id", F.col("t").cast("timestamp_ntz").alias("timestamp"))
    row = ordered.gap_stats(df, [], "timestamp", ORDER, chunks).first()
    assert row["mean"] == pytest.approx(1_000_000.000333333, rel=1e-12)
    assert row["std"] == pytest.approx(0.000577350269, rel=1e-6)


def test_gaps_and_windows_in_any_session_zone(spark):
    df = spark.sql("SELECT * FROM VALUES (0L, timestamp_ntz'2024-03-10 01:30:00'), (1L, timestamp_ntz'2024-03-10 03:30:00') AS t(event_id, timestamp)")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert ordered.gap_stats(df, [], "timestamp", ORDER).first()["mean"] == 7200
            scopes = [str(r["scope"]) for r in with_scope(df, 3600).orderBy("event_id").collect()]
            assert scopes == ["2024-03-10 01:00:00", "2024-03-10 03:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
