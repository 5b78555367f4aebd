import hashlib
import random
from collections import Counter, defaultdict

import pytest

from eventlens.llm import exact_dedup, sharding
from tests.llm.conftest import ODD


def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lower_ascii(text)].append(i)
    return Counter(
        (i, max(g), len(g), i == max(g), hashlib.sha256(lower_ascii(t).encode()).hexdigest())
        for i, t in rows
        for g in [groups[lower_ascii(t)]]
    )


@pytest.mark.parametrize("support", [0.001, 0.2, 0.9])
def test_exact_groups_equal_grouping_by_text(documents, support):
    rnd = random.Random(3)
    rows = [(100 + i, rnd.choice(["Hot", "hOT", "École", "éCOLE", f"t{rnd.randint(0, 20)}"])) for i in range(400)] + ODD
    found = exact_dedup.exact_groups(documents(rows), support=support)
    assert Counter(map(tuple, found.collect())) == expected_groups(rows)


def test_exact_dedup_keeps_rows_and_columns(documents):
    docs = documents(ODD)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 6, 7, 8, 9, 10, 11, 12, 13}
    assert exact_dedup.exact_groups(documents([(1, "a")]).limit(0)).count() == 0


def test_null_ids_form_groups(documents):
    found = {tuple(r)[:4] for r in exact_dedup.exact_groups(documents([(None, "a"), (5, "a"), (None, "b")])).collect()}
    assert found == {(None, 5, 2, False), (5, 5, 2, True), (None, None, 1, True)}


def test_table_is_filled_in_turns_by_preference():
    shards, slots = ("a", "b", "c"), 31
    table = sharding.lookup_table(shards, slots)
    orders = []
    for s in shards:
        offset, skip = sharding._hashed(s, "offset") % slots, sharding._hashed(s, "skip") % (slots - 1) + 1
        orders.append([(offset + j * skip) % slots for j in range(slots)])
    taken = {}
    for turn in range(slots):
        order = orders[turn % 3]
        taken[next(s for s in order if s not in taken)] = turn % 3
    assert [taken[s] for s in range(slots)] == table


def test_shares_differ_by_one_slot_and_few_slots_move():
    before, after = sharding.lookup_table(), sharding.lookup_table((*sharding.SHARDS, "new"))
    counts = Counter(before).values()
    assert max(counts) - min(counts) <= 1
    moved = sum(a != b and b != len(sharding.SHARDS) for a, b in zip(before, after, strict=True))
    assert moved < 0.1 * len(before)
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(("a", "b"), 100)


def test_every_row_has_the_shard_of_its_id(documents, tmp_path):
    rows = [(i, "t") for i in range(500)] + [(None, "t"), (7, "t")]
    table = sharding.lookup_table()

    def place(i):
        return int(hashlib.sha256(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) % sharding.SLOTS

    found = sharding.assign(documents(rows)).collect()
    assert Counter(map(tuple, found)) == Counter((i, place(i), sharding.SHARDS[table[place(i)]]) for i, _ in rows)
    assert sharding.assign(documents(rows).limit(0)).count() == 0
    docs = documents(rows).drop("shard")
    sharding.write_shards(docs, f"{tmp_path}/out")
    back = docs.sparkSession.read.parquet(f"{tmp_path}/out")
    assert Counter((r.doc_id, r.shard) for r in back.collect()) == Counter((r.doc_id, r.shard) for r in found)
