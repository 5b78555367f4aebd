"""Near duplicates: consistent weighted samples of TF-IDF shingles, banded, checked by weighted Jaccard similarity.

* Words are runs of letters, digits and bytes above ASCII, A-Z lowered; shingles are five words (all words of
  a shorter text). A shingle weighs its count times ``1 + ln((1 + N) / (1 + df)) / ln(1 + N)``. Document
  frequencies are counted over all rows: blocks of documents send their different shingles with counts to
  ranges of shingles, and get back those that several documents have. A block or a range is about ``BLOCK``
  bytes of text at any size of the table.
* Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per document; two documents share a
  sample with the probability of their similarity. Documents of equal words share everything and are one
  node from here on, so copies are never expanded.
* A band's samples are a key. Every document of a key is compared with the key's hub, the document that meets
  most others over all its keys; a key may be as hot as it likes, each of its documents gives one pair. Links
  of at least ``THRESHOLD`` on the whole texts make groups by connected components.
* Where this leaves documents of a key in different groups, those outside its largest group are compared with
  all others of the key, as products of weights and shared shingles. A key is cut into chunks of about ``GROUP``
  shingles or ``DOCUMENTS`` documents, and every pair of chunks is compared by itself, so no pair of documents
  that shares a key is left out at any size; what leaves the task is a spanning forest of the links found.
  A key whose documents stay apart costs the square of its chunks.

Cases: null counts as empty. Texts without words are equal if their bytes are, else unlike any other. A text
of one to four words is one shingle. Rows with the same id and text are one document; an id that comes with
several texts, or none, has a document for each of them (``row_ids``). The smallest id of a group is its class
and stays, the one with the smaller SHA-256 among equal ids; rows without an id come last, and if a whole
group has none, its class is null. An empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventlens.llm.components import components
from eventlens.llm.row_ids import keyed
from eventlens.llm.texts import lowered, prepare, release, released, slices, spread
from eventlens.session import settle

WORDS = 5
THRESHOLD = 0.8
BANDS = 12
ROWS = 3
# Bytes of text of a block of documents, and behind a range of shingles.
BLOCK = 8 << 20
# Shingles and documents of a chunk of a key; two chunks are compared at once.
GROUP = 1_000_000
DOCUMENTS = 2_000
SIGNED = [("doc_id", pa.int64()), ("words", pa.binary()), ("bands", pa.list_(pa.int64())), ("size", pa.int64()), ("df", pa.binary())]
# Bytes of text per step: its arrays stay in a core's cache.
STEP = 1 << 20

U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all of the input."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, U(base))
    out[:1] = U(1)
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and the bounds of the texts' words."""
    small = lowered(flat)
    inside = _WORD[small]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = inside[first]
    places = np.flatnonzero(starts)
    bounds = np.searchsorted(places, offsets)
    if not len(places):
        return np.empty(0, np.uint64), bounds
    number = np.cumsum(starts) - 1
    depth = np.arange(len(flat)) - places[np.maximum(number, 0)]
    # A word's number in base p; separators behind it count nothing.
    power = powers(0x9E3779B97F4A7C15, int(depth.max()) + 1)
    value = np.where(inside, (small.astype(np.uint64) + U(1)) * power[depth], U(0))
    return mixed(np.add.reduceat(value, places)), bounds


def shingles(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of all texts as 44-bit numbers, their counts, their bounds, and a 128-bit digest of each text's words."""
    words, bounds = word_hashes(flat, offsets)
    sizes = np.diff(bounds)
    filler = WORDS - 1
    padded = np.zeros(len(words) + filler * len(sizes) + filler, np.uint64)
    starts = bounds[:-1] + filler * np.arange(len(sizes))
    padded[spread(sizes, starts)] = words
    total = np.zeros(len(padded) - filler, np.uint64)
    for k, factor in enumerate(powers(0xD6E8FEB86659FD93, WORDS)):
        total += padded[k : k + len(total)] * factor
    counts = np.where(sizes >= WORDS, sizes - filler, np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(sizes)), counts)
    own = mixed(total[spread(counts, starts)]) >> U(20)
    keys = np.sort((row.astype(np.uint64) << U(44)) | own)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    limits = np.searchsorted(keys, np.arange(len(sizes) + 1, dtype=np.uint64) << U(44))
    return keys & U((1 << 44) - 1), times, limits, _digests(words, bounds)


def _digests(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's words in order."""
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), 2), np.uint64)
    if len(words):
        place = np.arange(len(words)) - np.repeat(bounds[:-1], sizes)
        filled = np.flatnonzero(sizes > 0)
        for k, base in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            value = mixed(words ^ U(k * 0x9E37 + 1)) * powers(base | 1, int(sizes.max()))[place]
            out[filled, k] = mixed(np.add.reduceat(value, bounds[:-1][filled]) + sizes[filled].astype(np.uint64))
    return out


def weights(times: np.ndarray, df: np.ndarray, documents: int) -> np.ndarray:
    return times * (1 + np.log((1 + documents) / (1.0 + df)) / np.log(1 + max(1, documents)))


@lru_cache(maxsize=1)
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the Gamma(2, 1) distribution, and their logarithms on a finer grid."""

    def inverse(count: int) -> np.ndarray:
        wanted = (np.arange(count) + 0.5) / count
        low, high = np.zeros(count), np.full(count, 40.0)
        for _ in range(60):
            middle = (low + high) / 2
            less = 1 - (1 + middle) * np.exp(-middle) < wanted
            low, high = np.where(less, middle, low), np.where(less, high, middle)
        return (low + high) / 2

    return inverse(1 << 12).astype(np.float32), np.log(inverse(1 << 16)).astype(np.float32)


def samples(ids: np.ndarray, weight: np.ndarray, bounds: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """Consistent weighted samples of every text: 32 bits of (shingle, level) of the least draw. Texts without shingles get zeros."""
    gamma, log_gamma = _quantiles()
    filled = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, count), np.uint32)
    if not len(filled):
        return out
    firsts = bounds[:-1][filled]
    log_weight = np.log(weight).astype(np.float32)
    for k, seed in enumerate(powers(0x9E3779B97F4A7C15, count + 1)[1:]):
        drawn = mixed(ids ^ seed)
        r = gamma[(drawn & U(0xFFF)).astype(np.int32)]
        c = log_gamma[((drawn >> U(12)) & U(0xFFFF)).astype(np.int32)]
        beta = ((drawn >> U(28)) & U(0xFFFF)).astype(np.float32) * np.float32(2**-16)
        level = np.floor(log_weight / r + beta)
        draw = c - r * (level - beta + np.float32(1))
        # Floats as unsigned numbers of the same order, above what identifies the sample.
        bits = draw.view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))
        name = (ids + level.astype(np.int64).astype(np.uint64) * U(0x9FB21C651E98DF25)) * U(0xC2B2AE3D27D4EB4F)
        least = np.minimum.reduceat((bits.astype(np.uint64) << U(32)) | (name >> U(32)), firsts)
        out[filled, k] = (least & U(0xFFFFFFFF)).astype(np.uint32)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    grouped = found.reshape(len(found), BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * U(0x165667B19E3779F9)
    for k in range(ROWS):
        total = mixed(total ^ grouped[:, :, k])
    return total.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of (shingles, weights); shingles in rising order."""
    _, one, two = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][one], b[1][two]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total else 0.0


def packed_ids(ids: np.ndarray) -> bytes:
    """Rising 44-bit numbers as bytes: the first, and the steps between them in 4 bytes each, or in 6 where one is too long for that."""
    if not len(ids):
        return b""
    steps = np.diff(ids, prepend=ids[:1])
    width = 4 if int(steps.max()) < 1 << 32 else 6
    return int(ids[0]).to_bytes(7, "little") + bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_ids(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    first, width = int.from_bytes(data[:7], "little"), data[7]
    steps = np.zeros(((len(data) - 8) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=8).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + U(first)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte per count; 255 stands for a larger one, and these follow."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def unpacked_counts(data: bytes, size: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, count=size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=size)
    return counts


def _blocks(texts: DataFrame) -> tuple[DataFrame, int, int]:
    """``texts`` with block, the number of blocks, and that of the rows."""
    total = texts.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("size")).first()
    blocks = (total["size"] or 0) // BLOCK + 1
    return texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))), blocks, total["rows"]


def _frequencies(blocked: DataFrame, ranges: int) -> DataFrame:
    """block, ids, df: a block's shingles that several documents have, and in how many they are."""

    def gather(rows: pa.Table) -> pa.Table:
        found = [shingles(flat, offsets)[0] for batch in rows.combine_chunks().to_batches() for _, flat, offsets in slices(iter([batch]), size=STEP)]
        ids, counts = np.unique(np.concatenate(found), return_counts=True)
        limits = np.searchsorted(ids, np.array([(k << 44) // ranges for k in range(ranges + 1)], np.uint64))
        own = np.flatnonzero(np.diff(limits))
        part = [(packed_ids(ids[limits[k] : limits[k + 1]]), packed_counts(counts[limits[k] : limits[k + 1]])) for k in own]
        block = rows.column("block")[0].as_py()
        release()
        return pa.table(
            {"block": pa.array([block] * len(own), pa.int64()), "part": pa.array(own), "ids": pa.array([x for x, _ in part], pa.binary()), "df": pa.array([x for _, x in part], pa.binary())}
        )

    def count(rows: pa.Table) -> pa.Table:
        ids = [unpacked_ids(x) for x in rows.column("ids").to_pylist()]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        part_ids, ids = ids, np.concatenate(ids)
        own, place = np.unique(ids, return_inverse=True)
        times = np.concatenate([unpacked_counts(x, len(i)) for x, i in zip(rows.column("df").to_pylist(), part_ids, strict=True)])
        df = np.zeros(len(own), np.int64)
        np.add.at(df, place, times)
        df = df[place]
        several = df > 1
        sent = [(packed_ids(ids[a:b][several[a:b]]), packed_counts(df[a:b][several[a:b]])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({"block": rows.column("block"), "ids": pa.array([x for x, _ in sent], pa.binary()), "df": pa.array([x for _, x in sent], pa.binary())})

    parts = blocked.select("block", "text").groupBy("block").applyInArrow(gather, "block long, part long, ids binary, df binary")
    return parts.groupBy("part").applyInArrow(count, "block long, ids binary, df binary")


def _unpacked(frequencies: list[bytes]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *[np.frombuffer(zlib.decompress(x), "<i8") for x in frequencies]])


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, copy_of (smallest id with the same words), class_id, kept for every row."""
    plain = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    rows, names = keyed(plain, nulls_first=False)
    found = _classes(rows, threshold).withColumn("kept", F.col("id") == F.col("class_id"))
    if names is None:
        return found.select(F.col("id").alias("doc_id"), "copy_of", "class_id", "kept")
    for column, told in (("id", "doc_id"), ("copy_of", "copy_name"), ("class_id", "class_name")):
        found = found.join(names.select(F.col("id").alias(column), F.col("doc_id").alias(told)), column)
    return found.select("doc_id", F.col("copy_name").alias("copy_of"), F.col("class_name").alias("class_id"), "kept")


def _classes(rows: DataFrame, threshold: float) -> DataFrame:
    """id, copy_of, class_id for every row; an id stands for one text."""
    prepare(rows.sparkSession)
    texts = rows.select(F.col("id").alias("doc_id"), "text")
    blocked, blocks, documents = _blocks(texts)
    signed = settle(_signed(blocked, _frequencies(blocked, blocks), documents))
    # A table of its own: joined straight after the aggregate, a hot digest's rows could not be split.
    copies = settle(signed.groupBy("words").agg(F.min("doc_id").alias("copy_of")))
    named = settle(signed.select("doc_id", "words").join(copies, "words").select("doc_id", "copy_of"))
    nodes = settle(
        signed.where(F.size("bands") > 0)
        .join(copies.select(F.col("copy_of").alias("doc_id"), "words"), ["doc_id", "words"], "left_semi")
        .dropDuplicates(["doc_id"])
    )
    keys = settle(nodes.select("doc_id", "size", F.posexplode("bands").alias("band", "key")))
    members = settle(_members(keys))
    pairs = members.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    # Merge joins where texts move: the plan is the same at every size of the table.
    asked = nodes.select("doc_id", "df").join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    own = settle(texts.join(asked.hint("merge"), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "df"))
    links = settle(_checked(pairs, own, documents, threshold))
    groups = settle(components(links))
    further = settle(_within_keys(members, own, groups, documents, threshold))
    if further.limit(1).count():
        groups = settle(components(links.unionByName(further)))
    return named.join(groups.withColumnRenamed("node", "copy_of"), "copy_of", "left").select(
        F.col("doc_id").alias("id"), "copy_of", F.coalesce("component", "copy_of").alias("class_id")
    )


def _members(keys: DataFrame) -> DataFrame:
    """Rows of the keys that several documents share, with the key's hub."""
    shared = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("number")).where("number > 1")
    met = keys.join(shared, ["band", "key"])
    busy = met.groupBy("doc_id").agg(F.sum("number").alias("meets"))
    hubs = met.join(busy, "doc_id").groupBy("band", "key").agg(F.max_by("doc_id", F.struct("meets", -F.col("doc_id"))).alias("hub"))
    return met.join(hubs, ["band", "key"]).select("doc_id", "size", "band", "key", "hub")


def _signed(blocked: DataFrame, frequencies: DataFrame, documents: int) -> DataFrame:
    """doc_id, words (a digest of the words, or of the bytes where there are none), bands, size (its number of shingles), df (of each, packed)."""

    def sign(texts: pa.Table, known: pa.Table) -> pa.Table:
        import hashlib

        told = [unpacked_ids(x) for x in known.column("ids").to_pylist()]
        several = np.concatenate([np.empty(0, np.uint64), *told])
        counted = np.concatenate([np.empty(0, np.int64), *[unpacked_counts(x, len(i)) for x, i in zip(known.column("df").to_pylist(), told, strict=True)]])
        order = np.argsort(several)
        several, counted = np.append(several[order], ~U(0)), np.append(counted[order], 1)
        out = []
        for rows, flat, offsets in slices(iter(texts.combine_chunks().to_batches()), size=STEP):
            ids, times, bounds, digests = shingles(flat, offsets)
            at = np.searchsorted(several, ids)
            df = np.where(several[at] == ids, counted[at], 1)
            found = samples(ids, weights(times, df, documents), bounds)
            keys, filled = band_keys(found), np.diff(bounds) > 0
            data = flat.tobytes()
            words = [
                digests[i].tobytes() if filled[i] else b"=" + hashlib.sha256(data[offsets[i] : offsets[i + 1]]).digest() for i in range(len(filled))
            ]
            limits = np.concatenate(([0], np.cumsum(filled * BANDS))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(limits), pa.array(np.ascontiguousarray(keys[filled]).reshape(-1)))
            packed = [zlib.compress(df[a:b].astype("<i8").tobytes(), 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            out.append(
                pa.Table.from_arrays(
                    [rows.column("doc_id"), pa.array(words, pa.binary()), bands, pa.array(np.diff(bounds)), pa.array(packed, pa.binary())],
                    names=["doc_id", "words", "bands", "size", "df"],
                )
            )
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in SIGNED})

    sides = blocked.groupBy("block").cogroup(frequencies.groupBy("block"))
    return sides.applyInArrow(sign, "doc_id long, words binary, bands array<long>, size long, df binary")


def _checked(pairs: DataFrame, texts: DataFrame, documents: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, offsets in slices(iter([batch]), "one", STEP):
                first = _weighted(flat, offsets, rows.column("df_one"), documents)
                second = []
                for part, other, ends in slices(iter([rows]), "two", STEP):
                    second += _weighted(other, ends, part.column("df_two"), documents)
                good = np.array([similarity(x, y) for x, y in zip(first, second, strict=True)]) >= threshold
                yield rows.select(["a", "b"]).filter(pa.array(good))

    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("one"), F.col("df").alias("df_one"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("two"), F.col("df").alias("df_two"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return both.select("a", "b", "one", "two", "df_one", "df_two").mapInArrow(released(check), "a long, b long")


def _weighted(flat: np.ndarray, offsets: np.ndarray, frequencies: pa.Array, documents: int) -> list[tuple[np.ndarray, np.ndarray]]:
    ids, times, bounds, _ = shingles(flat, offsets)
    weight = weights(times, _unpacked(frequencies.to_pylist()), documents)
    return [(ids[a:b], weight[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _meetings(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Documents of open keys with ``met``, the pairs of chunks (i, j) they are in: as one of x if x = i, as one of y if y = j.

    Documents outside the key's largest group, in ``across`` chunks, meet all of the key's documents, in ``down`` chunks.
    """
    placed = members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("own", F.coalesce("component", "doc_id"))
    sizes = placed.groupBy("band", "key", "own").agg(F.count(F.lit(1)).alias("number"), F.sum("size").alias("size"))
    main = F.max(F.struct("number", "size", "own")).alias("main")
    open_ = sizes.groupBy("band", "key").agg(F.count(F.lit(1)).alias("groups"), F.sum("number").alias("number"), F.sum("size").alias("total"), main)
    open_ = open_.where("groups > 1").select(
        "band",
        "key",
        F.col("main.own").alias("main"),
        _chunks(F.col("number") - F.col("main.number"), F.col("total") - F.col("main.size")).alias("across"),
        _chunks(F.col("number"), F.col("total")).alias("down"),
    )
    draw = F.xxhash64("doc_id", "band", "key")
    rows = placed.join(open_, ["band", "key"]).select(
        "band", "key", "doc_id", "own", "across", "down", F.when(F.col("own") != F.col("main"), F.pmod(draw, "across")).alias("x"), F.pmod(draw, "down").alias("y")
    )
    met = F.concat(
        F.expr("if(x is null, array(), transform(sequence(0L, down - 1), k -> struct(x as i, k as j)))"),
        F.expr("transform(sequence(0L, across - 1), k -> struct(k as i, y as j))"),
    )
    return rows.select("band", "key", "doc_id", "own", "x", "y", F.array_distinct(met).alias("met"))


def _within_keys(members: DataFrame, texts: DataFrame, groups: DataFrame, documents: int, threshold: float) -> DataFrame:
    """Links (a, b) between documents of a key that are in different groups so far: a spanning forest for each pair of chunks."""

    def compare(rows: pa.Table) -> pa.Table:
        names, own = rows.column("doc_id").to_numpy(), rows.column("own").to_numpy()
        one = np.flatnonzero(rows.column("one").to_numpy())
        two = np.flatnonzero(rows.column("two").to_numpy())
        out: list[tuple[int, int]] = []
        if len(one) and len(np.unique(own)) > 1:
            found = [x for batch in rows.combine_chunks().to_batches() for part, flat, offsets in slices(iter([batch]), size=STEP) for x in _shingled(flat, offsets, part.column("df"))]
            out = _forest(own, _similar(found, documents, threshold, one, two, own))
        ends = names[np.array(out, np.int64).reshape(-1, 2)]
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    pairs = _meetings(members, groups).join(texts.hint("merge"), "doc_id").select("band", "key", "doc_id", "own", "x", "y", "text", "df", F.inline("met"))
    pairs = pairs.select("band", "key", "i", "j", "doc_id", "own", F.expr("x <=> i").alias("one"), F.expr("y <=> j").alias("two"), "text", "df")
    return pairs.groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _chunks(number: Column, size: Column) -> Column:
    """How many chunks hold so many documents of so many shingles."""
    return F.greatest(F.ceil(number / DOCUMENTS), F.ceil(size / GROUP)).cast("long")


def _shingled(flat: np.ndarray, offsets: np.ndarray, frequencies: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids, times, bounds, _ = shingles(flat, offsets)
    df = _unpacked(frequencies.to_pylist())
    return [(ids[a:b], times[a:b], df[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _similar(
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], documents: int, threshold: float, one: np.ndarray, two: np.ndarray, own: np.ndarray
) -> np.ndarray:
    """Row numbers (i, j), i of ``one`` and j of ``two``, of the sets of different groups that are similar enough.

    The k-th of equal shingles is a feature of its own.
    """
    number = len(found)
    ids, times, df = (np.concatenate([f[k] for f in found]) for k in range(3))
    row = np.repeat(np.repeat(np.arange(number), [len(f[0]) for f in found]), times)
    turn = spread(times, np.zeros(len(times), np.int64)).astype(np.uint64)
    _, first, feature, counts = np.unique(np.repeat(ids, times) ^ (turn << U(44)), return_index=True, return_inverse=True, return_counts=True)
    weight = weights(np.ones(len(first)), np.repeat(df, times)[first], documents)
    total = np.bincount(row, weight[feature], minlength=number)
    common = np.zeros((len(one), len(two)))
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(counts), -1)
    step = max(64, 4_000_000 // number)
    for at in range(0, len(shared), step):
        part = shared[at : at + step]
        place[:] = -1
        place[part] = np.arange(len(part))
        columns = place[feature]
        has = np.zeros((number, len(part)))
        has[row[columns >= 0], columns[columns >= 0]] = 1
        common += (has[one] * weight[part]) @ has[two].T
    close = common >= threshold * (total[one][:, None] + total[two][None, :] - common) * (1 - 1e-12)
    i, j = np.nonzero(close & (own[one][:, None] != own[two][None, :]))
    return np.column_stack((one[i], two[j]))


def _forest(own: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """The links that join groups which were apart until then, in order."""
    parent = {int(g): int(g) for g in own}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in links.tolist():
        a, b = root(int(own[i])), root(int(own[j]))
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of one document of each group, with all their columns."""
    plain = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, _ = keyed(plain, nulls_first=False)
    stay = _classes(rows.select("id", "text"), threshold).where("id = class_id").select("id").distinct()
    return rows.join(stay.hint("merge"), "id", "left_semi").select("row.*")
