import math
import random
from collections import Counter, defaultdict

import pytest
from helpers import START, entropy, features_of, frame, sample_events
from pyspark.sql import functions as F

from eventlens.functions.text import file_extension, path_depth, special_char_ratio
from eventlens.functions.time import floor_time, parse_time, time_parts
from eventlens.operators import features, tfidf

SMOOTH = 1e-10


def test_empty_batch_has_no_features(spark):
    empty = frame(spark, [{}]).where("false")
    assert features.extract(empty, ["event_type"], features.FAMILIES).count() == 0


def test_one_row(spark):
    got = features_of(features.merge_features(features.extract(frame(spark, [{"command": "ls"}]), [], features.FAMILIES), []))
    assert got["std_time_interval"] is None and got["avg_time_interval"] is None
    assert not any("transition" in name for name in got)
    assert got["event_type_x"] == 1 and got["std_execution_time"] is None


def test_all_null_command(spark):
    rows = frame(spark, [{}, {}, {}])
    got = features_of(features.merge_features(features.extract(rows, [], features.FAMILIES), []))
    assert got["unique_commands"] == 0 and got["command_entropy"] == 0.0
    assert got["command_max_length"] is None and got["command_avg_length"] is None
    assert got["command_special_char_ratio"] == 0.0 and got["path_avg_depth"] == 1.0
    assert got["source_ip_count"] == 0 and got["source_ip_max_frequency"] is None
    assert got["total_packets"] == 0 and got["avg_packets_per_connection"] is None
    assert got["command_transition_None->None"] == 2
    assert not any(name.startswith("command_tfidf") for name in got)


def test_absent_columns_give_no_features(spark):
    rows = frame(spark, [{"command": "ls"}]).drop("username", "source_ip", "command")
    names = set(features_of(features.extract(rows, [], features.BASIC)))
    assert "event_type_x" in names and "process_count" in names
    assert not names & {"user_count", "failed_login_count", "unique_files_accessed", "unique_commands", "source_ip_count"}


def test_unknown_family_raises(spark):
    with pytest.raises(ValueError, match="unknown feature families"):
        features.extract(frame(spark, [{}]), [], ["nope"])


def test_null_mix_per_key_and_joint(spark):
    rows = frame(
        spark,
        [
            {"username": "a", "command": "x"},
            {"username": "a"},
            {"command": "y"},
            {"username": "b"},
        ],
    )
    got = features_of(features.pair_features(rows, [], ["correlation", "entropy"]))
    assert (got["avg_commands_per_user"], got["max_commands_per_user"], got["min_commands_per_user"]) == (0.5, 1, 0)
    assert got["avg_unique_commands_per_user"] == 0.5
    assert got["username_command_joint_entropy"] == pytest.approx(-1.4426951601859516e-10)


def test_one_value_entropies(spark):
    rows = frame(spark, [{"event_type": "t", "protocol": "TCP"}] * 4)
    got = features_of(features.field_features(rows, [], ["network", "entropy"]))
    assert got["protocol_entropy"] == 0.0 and math.copysign(1, got["protocol_entropy"]) == 1
    assert got["event_type_entropy"] == pytest.approx(-1.4426951601859516e-10, rel=1e-6)


def test_ties_follow_event_id(spark):
    rows = frame(spark, [{"event_id": i, "timestamp": 0, "event_type": t} for i, t in ((2, "c"), (0, "a"), (1, "b"))])
    got = features_of(features.sequence_features(rows, [], kinds=["event"]))
    assert {n for n in got if "->" in n} == {"event_transition_a->b", "event_transition_b->c"}


def test_paths_and_special_characters(spark):
    paths = ["/etc/conf.d/passwd", "README", "/a/b/", "", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select(file_extension(F.col("p")), path_depth(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("d/passwd", 4), ("no_extension", 1), ("no_extension", 4), ("no_extension", 1), ("no_extension", 1)]
    texts = ["a b", "a-b", " ", "\x1c", "", None, "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(special_char_ratio(F.col("t"))).collect()]
    assert got == pytest.approx([0, 1 / 3, 0, 0, 0, 0, 1])


def test_time_functions(spark):
    df = spark.createDataFrame([(START,)], "t timestamp_ntz")
    parts = time_parts(F.col("t"))
    row = df.select(parts["hour"], parts["day_of_week"], floor_time(F.col("t"), 7).alias("f"), floor_time(F.col("t"), 300)).first()
    epoch = int((START - START.__class__(1970, 1, 1)).total_seconds())
    assert row[0] == 0 and row[1] == 0 and row[3] == START
    assert (START - row["f"]).total_seconds() == epoch % 7
    text = spark.createDataFrame([("2024-01-01T00:00:00",), ("bad",)], "t string")
    assert text.select(parse_time(F.col("t"), strict=False).alias("t")).collect()[1]["t"] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.select(parse_time(F.col("t"))).collect()


def test_later_family_wins(spark):
    rows = frame(spark, [{"username": "u", "command": c} for c in ("a", "a", "b")])
    basic = features_of(features.merge_features(features.extract(rows, [], features.BASIC), []))
    both = features_of(features.merge_features(features.extract(rows, [], features.FAMILIES), []))
    assert basic["command_entropy"] == pytest.approx(entropy("aab"), abs=1e-15)
    assert both["command_entropy"] == pytest.approx(entropy("aab", SMOOTH), abs=1e-15)
    assert both["command_entropy"] != basic["command_entropy"]


def test_whole_batch_against_plain_python(spark):
    events = sample_events(spark)
    rows = sorted(events.collect(), key=lambda r: (r["timestamp"], r["event_id"]))
    got = features_of(features.merge_features(features.extract(events, [], features.FAMILIES), []))
    by_user = defaultdict(list)
    for r in rows:
        by_user[r["username"]].append(r["command"])
    counts = [sum(c is not None for c in v) for v in by_user.values()]
    steps = Counter(f"{a['event_type']}->{b['event_type']}" for a, b in zip(rows, rows[1:]))
    gaps = [(b["timestamp"] - a["timestamp"]).total_seconds() for a, b in zip(rows, rows[1:])]
    assert got["user_count"] == len(by_user)
    assert got["avg_commands_per_user"] == pytest.approx(sum(counts) / len(counts))
    assert got["event_transition_entropy"] == pytest.approx(entropy(steps.elements(), SMOOTH))
    assert {n[17:]: v for n, v in got.items() if n.startswith("event_transition_") and "->" in n} == steps
    assert sum(steps.values()) == len(rows) - 1
    mean = sum(gaps) / len(gaps)
    assert got["avg_time_interval"] == pytest.approx(mean)
    assert got["std_time_interval"] == pytest.approx(math.sqrt(sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1)))
    pairs = [(r["username"], r["command"]) for r in rows if r["command"] is not None]
    assert got["username_command_joint_entropy"] == pytest.approx(entropy(pairs, SMOOTH))
    assert got["ip_joint_entropy"] >= max(got["source_ip_entropy"], got["destination_ip_entropy"]) - 1e-9
    for name in ("username", "event_type", "source_ip"):
        distinct = len({r[name] for r in rows})
        assert 0 <= got[f"{name}_entropy"] <= math.log2(distinct) + 1e-9


def test_matrix_columns(spark):
    rows = frame(spark, [{"event_type": "a"}, {"event_type": "b", "timestamp": 4000}])
    scoped = features.with_scope(rows)
    long = features.extract(scoped, ["scope"], ["event_type"])
    wide = features.feature_matrix(long, ["scope"], ["event_type_b", "event_type_a", "other"])
    assert wide.columns == ["scope", "event_type_b", "event_type_a", "other"]
    assert [tuple(r)[1:] for r in wide.orderBy("scope").collect()] == [(0, 1, 0), (1, 0, 0)]
    with pytest.raises(ValueError, match="other"):
        features.feature_matrix(long, ["scope"], ["other"], strict=True)
    assert {r[0] for r in features.feature_names(long).collect()} == {"event_type_a", "event_type_b"}


def plain_tfidf(texts, stop, limit=100, ngrams=(1, 1)):
    import re

    docs = []
    for text in texts:
        words = [w for w in re.findall(r"\b\w\w+\b", (text or "").lower()) if w not in stop]
        docs.append([" ".join(words[i : i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(words) - n + 1)])
    total, df = Counter(t for d in docs for t in d), Counter(t for d in docs for t in set(d))
    kept = sorted(sorted(total, key=lambda t: (-total[t], t))[:limit])
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    sums = dict.fromkeys(kept, 0.0)
    for d in docs:
        w = {t: d.count(t) * idf[t] for t in set(d) if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            sums[t] += x / norm
    return {t: (i, sums[t] / len(docs)) for i, t in enumerate(kept)}


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2), (2, 3)])
@pytest.mark.parametrize("limit", [100, 3])
def test_tfidf_against_plain_python(spark, ngrams, limit):
    rng = random.Random(5)
    words = ["ls", "rm", "the", "Größe", "naïve", "x", "42", "cat", "grep"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(60)] + [None, "", "ls ls ls"]
    stop = ["the", "cat"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = tfidf.mean_tfidf(df, [], F.col("t"), limit, stop, ngrams).collect()
    want = plain_tfidf(texts, stop, limit, ngrams)
    assert {r["term"]: r["i"] for r in got} == {t: i for t, (i, _) in want.items()}
    for r in got:
        assert r["weight"] == pytest.approx(want[r["term"]][1])


def test_tfidf_default_stop_words(spark):
    df = spark.createDataFrame([("the and or",), ("cat",)], "t string")
    assert [r["term"] for r in tfidf.mean_tfidf(df, [], F.col("t")).collect()] == ["cat"]
