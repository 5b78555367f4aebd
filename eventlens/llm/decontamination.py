"""Benchmark decontamination: winnowed fingerprints are joined, and their hits extended to whole windows of words.

Words are runs of digits, letters a-z (A-Z lowered) and all characters beyond ASCII. A window is ``WINDOW``
neighbouring words of an item, or all words of a shorter item. Of a window of n words, every (n + 1) // 2
neighbouring words are a gram, and the least of its grams' hashes is its fingerprint. Documents keep the
fingerprint of each of their own windows of that length, once for all neighbouring windows that share it
(two in seven places for windows of ten words). Equal windows have equal fingerprints, so every shared span of
a window's length is among the matches. Matches only name places: the document's windows there, and further
on as long as the fingerprint stays the same, are written out, and their words are compared with the item's.

Documents are read twice: all for fingerprints, which meet those of the benchmark, and once more for the words of
those with a match. Only keys and matched places move; where a side is too large to be broadcast, fingerprints, and
texts of documents. Windows of the benchmark are grouped by their words first, so a document's window meets
one row however many items hold it, and a passage in many documents is the larger side's skew, which is split.
Whether the fingerprints, windows or places are broadcast is left to their measured size. Everything runs on
DataFrame functions.

Cases: a null text, and one without letters and digits, has no words; such an item has no window. A text of
any length is searched whole. Every row of the documents has a row in the result; rows with the same id and
text have equal ones. Items that share an id count once, and an item without an id is listed as the empty
text. Either table may be empty. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from eventlens.llm.exact_dedup import normalised
from eventlens.session import settle

# What stands between the words of a text after A-Z are lowered, and the words of a window.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10

# A place of a document stands for at most so many windows behind it.
STRETCH = 64


def words(text: Column) -> Column:
    # Splitting takes a third of the time of extracting each word; it leaves an empty part at either end.
    return F.array_remove(F.split(normalised(text), BETWEEN), "")


def windows(items: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """The different windows of the items: window (its words), length, items (ids as texts)."""
    split = items.select(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("item"), words(F.col(f"`{text_column}`")).alias("words"))
    n = F.size("words")
    places = F.when(n > window, F.sequence(F.lit(1), n - window + 1)).when(n > 0, F.array(F.lit(1)))
    placed = split.select("item", "words", F.explode(places).alias("place"))
    return (
        placed.select("item", F.slice("words", F.col("place"), F.lit(window)).alias("words"))
        .groupBy(F.array_join("words", " ").alias("window"), F.size("words").alias("length"))
        .agg(F.collect_set("item").alias("items"))
    )


def _with_fingerprints(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` with, for each length, an array of the fingerprints of the windows that start at each word.

    Each step is a column of its own, which the next one reads element by element.
    """
    kept = rows.columns
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    for length in lengths:
        gram = (length + 1) // 2
        rows = rows.withColumn(f"grams_{length}", _sliding("hashes", gram, lambda parts: F.xxhash64(*parts)))
    for length in lengths:
        gram = (length + 1) // 2
        rows = rows.withColumn(f"prints_{length}", _sliding(f"grams_{length}", length - gram + 1, lambda parts: F.least(*parts) if len(parts) > 1 else parts[0]))
    return rows.select(*kept, *[f"prints_{length}" for length in lengths])


def _sliding(name: str, width: int, combine) -> Column:
    """``combine`` of every ``width`` neighbouring elements of the array column; empty if it is shorter."""
    places = F.sequence(F.lit(0), F.size(name) - width)
    each = F.transform(places, lambda i: combine([F.get(F.col(name), i + j) for j in range(width)]))
    return F.when(F.size(name) >= width, each).otherwise(F.array().cast("array<bigint>"))


def find(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_sha256, n_words, hits (start and length of the windows that occur), items (their ids as sorted texts)."""
    known = settle(windows(items, item_id_column, item_text_column, window))
    # At most ``window`` different ones.
    lengths = sorted(r.length for r in known.select("length").distinct().collect())
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    seen = settle(_matches(rows, known, lengths))
    hits = _compared(rows, seen.where("start >= 0"), known, lengths)
    itself = seen.where("start < 0").select(F.col("of.doc_id").alias("doc_id"), F.col("of.sha").alias("text_sha256"), F.col("of.n_words").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_sha256") == F.col("hit_sha"))
    return itself.join(hits, same, "left").select(
        "doc_id", "text_sha256", "n_words",
        F.coalesce("hits", F.array().cast("array<struct<start: bigint, length: bigint>>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _matches(rows: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """key, start, length of every place whose fingerprint is one of the benchmark's, and for every row itself one with start -1 and ``of``."""
    prints = _with_fingerprints(known.select(F.split("window", " ").alias("words"), "length"), lengths)
    own = [F.when(F.col("length") == length, F.get(f"prints_{length}", F.lit(0))) for length in lengths]
    wanted = settle(prints.select("length", F.coalesce(*own, F.lit(None).cast("long")).alias("print")).distinct())
    split = rows.select("doc_id", "key", _sha(F.col("text")).alias("sha"), words(F.col("text")).alias("words"))
    read = _with_fingerprints(split.withColumn("n_words", F.size("words").cast("long")), lengths)
    # One array per row: first the row itself, by the hash of its key, so that these don't meet; then the places of each length in turn.
    all_ = F.concat(F.array(F.xxhash64("key")), *[_changes(length) for length in lengths])
    spread = read.select("key", "doc_id", "sha", "n_words", F.posexplode(all_).alias("at", "print")).where(F.col("print").isNotNull())
    first, start, length = F.lit(1).cast("long"), F.lit(-1).cast("long"), F.lit(0)
    for n in lengths:
        start = F.when(F.col("at") >= first, F.col("at") - first).otherwise(start)
        length = F.when(F.col("at") >= first, F.lit(n)).otherwise(length)
        first = first + F.greatest(F.col("n_words") - (n - 1), F.lit(0))
    emitted = spread.select(
        "key", "print", start.alias("start"), length.alias("length"), F.when(F.col("at") == 0, F.struct("doc_id", "sha", "n_words")).alias("of")
    )
    found = emitted.join(wanted.withColumn("there", F.lit(True)), ["length", "print"], "left")
    return found.where(F.col("there") | (F.col("start") < 0)).select("key", "start", "length", "of")


def _compared(rows: DataFrame, matches: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """hit_id, hit_sha, hits, items of the rows that hold windows of the benchmark."""
    places = settle(matches.groupBy("key").agg(F.collect_set(F.struct("start", "length")).alias("places")))
    # Equal keys of different rows only add places, and those are compared.
    chosen = rows.join(places, "key").select("doc_id", _sha(F.col("text")).alias("sha"), words(F.col("text")).alias("words"), "places")
    read = _with_fingerprints(chosen, lengths)
    candidates = reduce(F.concat, [_written_out(length) for length in lengths], F.array().cast(CANDIDATES))
    spread = read.select(F.col("doc_id").alias("hit_id"), F.col("sha").alias("hit_sha"), F.inline(candidates))
    return (
        spread.join(known.select("window", "items"), "window")
        .groupBy("hit_id", "hit_sha")
        .agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("hits"), F.collect_set("items").alias("lists"))
        .select("hit_id", "hit_sha", "hits", F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"))
    )


CANDIDATES = "array<struct<start: bigint, length: bigint, window: string>>"


def _changes(length: int) -> Column:
    """A row's fingerprints where they differ from the one before, and every ``STRETCH`` places; null elsewhere."""
    prints = F.col(f"prints_{length}")
    return F.transform(prints, lambda p, i: F.when((i % STRETCH == 0) | (p != F.get(prints, i - 1)), p))


def _written_out(length: int) -> Column:
    """The windows at the places of this length, and behind them while the fingerprint is the same."""
    name = f"prints_{length}"
    last = F.size(name) - 1
    here = F.transform(F.filter("places", lambda p: (p["length"] == length) & (p["start"] <= last)), lambda p: p["start"].cast("int"))
    starts = F.transform(
        here,
        lambda a: F.filter(F.sequence(a, F.least(a + STRETCH - 1, last)), lambda s: F.get(F.col(name), s) == F.get(F.col(name), a)),
    )
    return F.transform(
        F.array_distinct(F.flatten(starts)),
        lambda s: F.struct(
            s.cast("long").alias("start"), F.lit(length).cast("long").alias("length"),
            F.array_join(F.slice(F.col("words"), s + 1, F.lit(length)), " ").alias("window"),
        ),
    )


def words_hit(hits: Column) -> Column:
    """The number of words in at least one of the hits, which are sorted by their start."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("upto"), zero.alias("words"))

    def add(done: Column, hit: Column) -> Column:
        end = hit["start"] + hit["length"]
        new = F.greatest(end - F.greatest(hit["start"], done["upto"]), zero)
        return F.struct(F.greatest(end, done["upto"]).alias("upto"), (done["words"] + new).alias("words"))

    return F.aggregate(hits, start, add, lambda done: done["words"])


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find``'s rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(
        "doc_id", "n_words", words_hit(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) of which at most ``share`` of the words occur in the benchmark."""
    found = find(docs, items)
    bad = found.where(F.try_divide(words_hit(F.col("hits")), F.col("n_words")) > share)
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (_sha(F.col("text")) == F.col("__sha")), "left_anti")


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
