"""Queries of the operators over the test tables, and the SQL that states their results."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventlens.llm import decontamination, exact_dedup, language, merkle, near_dedup, neighbours, packing, periodic_runs, piece_transducer, quality, sharding, suffix_dedup, token_counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op7_exact_dedup",
    """
    WITH d AS (
      SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
      FROM documents
    )
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


# The table is stated by its filling: in each turn the shard whose turn it is takes its first free slot.
SHARDING_SQL = f"""
    WITH RECURSIVE shards AS (
      SELECT i, ('0x' || sha256('offset:shard-' || lpad(i::VARCHAR, 2, '0'))[1:15])::BIGINT % {sharding.SLOTS} AS o,
             ('0x' || sha256('skip:shard-' || lpad(i::VARCHAR, 2, '0'))[1:15])::BIGINT % {sharding.SLOTS - 1} + 1 AS k
      FROM range({len(sharding.SHARDS)}) t(i)
    ), orders AS (
      SELECT i, list((o + j * k) % {sharding.SLOTS} ORDER BY j) AS slots FROM shards, range({sharding.SLOTS}) r(j) GROUP BY i
    ), fill AS (
      SELECT 0::BIGINT AS turn, -1::BIGINT AS slot, list_transform(range({sharding.SLOTS}), lambda x: false) AS taken
      UNION ALL
      SELECT turn + 1, s, taken[1:s] || [true] || taken[s + 2:]
      FROM (SELECT turn, taken, list_filter(slots, lambda x: NOT taken[x + 1])[1] AS s
            FROM fill JOIN orders ON i = turn % {len(sharding.SHARDS)} WHERE turn < {sharding.SLOTS})
    )
    SELECT d.doc_id, f.slot, 'shard-' || lpad(((f.turn - 1) % {len(sharding.SHARDS)})::VARCHAR, 2, '0') AS shard
    FROM (SELECT doc_id, ('0x' || sha256(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT % {sharding.SLOTS} AS slot FROM documents) d
    JOIN fill f USING (slot)
    """


@query("op6_sharding", SHARDING_SQL)
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.round_trips(table(spark, sf_dir, "documents"))


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs))


@query("op4_neighbours")
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"))


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


# Trees are climbed level by level: n is the number of nodes of the level, i a node's place in it.
MERKLE_SQL = r"""
    WITH RECURSIVE table_ AS (
      SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs
    ), framed AS (
      SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
             text, replace(text, chr(10), '') AS cut,
             xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii((doc_id::VARCHAR)[k])::BIGINT),
               lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS crc
      FROM documents, table_
    ), hashed AS (
      SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) END AS tampered
      FROM framed
    ), leaves AS (
      SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER (PARTITION BY source) AS n,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
      FROM hashed
    ), tree(s, level, i, n, digest) AS (
      SELECT s, 0, i, n, leaf FROM leaves
      UNION ALL
      SELECT s, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY s, level, i // 3, n
    ), subroots AS (
      SELECT s, digest, count(*) OVER () AS n FROM tree WHERE n = 1
    ), top(level, i, n, digest) AS (
      SELECT 0, s, n, digest FROM subroots
      UNION ALL
      SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3, n
    ), climb(row, s, level, i, n, proof, folded) AS (
      SELECT row, s, 0, i, n, '', coalesce(tampered, leaf) FROM leaves
      UNION ALL
      SELECT c.row, c.s, c.level + 1, c.i // 3, (c.n + 2) // 3, c.proof || coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i <> c.i), ''),
             sha256(string_agg(CASE WHEN t.i = c.i THEN c.folded ELSE t.digest END, '' ORDER BY t.i))
      FROM climb c JOIN tree t ON t.s = c.s AND t.level = c.level AND t.i // 3 = c.i // 3
      WHERE c.n > 1 GROUP BY c.row, c.s, c.level, c.i, c.n, c.proof, c.folded
    ), climb_top(row, level, i, n, proof, folded) AS (
      SELECT c.row, 0, c.s, b.n, c.proof, c.folded FROM climb c JOIN subroots b ON b.s = c.s WHERE c.n = 1
      UNION ALL
      SELECT c.row, c.level + 1, c.i // 3, (c.n + 2) // 3, c.proof || coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i <> c.i), ''),
             sha256(string_agg(CASE WHEN t.i = c.i THEN c.folded ELSE t.digest END, '' ORDER BY t.i))
      FROM climb_top c JOIN top t ON t.level = c.level AND t.i // 3 = c.i // 3
      WHERE c.n > 1 GROUP BY c.row, c.level, c.i, c.n, c.proof, c.folded
    )
    SELECT l.doc_id, l.leaf, b.digest AS subroot, r.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root,
           c.folded = r.digest AS verified
    FROM leaves l JOIN subroots b ON b.s = l.s JOIN climb_top c ON c.row = l.row AND c.n = 1 JOIN top r ON r.n = 1
    """


@query("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and for every row whether its leaf, recomputed after tampering, still leads to the root."""
    cut = merkle.leaf([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.COLUMNS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, cut)
    found = merkle.manifest(table(spark, sf_dir, "documents"), carry={"tampered": tampered})
    folded = found.withColumn("folded", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select(
        "doc_id",
        *[merkle.as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(merkle.proof(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        merkle.as_hex(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def planted_places(doc_id: object, n_words: int) -> np.ndarray | None:
    """For a tenth of the documents, the words from a place on turn into repeats of the first ones there."""
    checksum = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if checksum % 10 or not n_words:
        return None
    group = checksum // 10
    first = group % n_words
    period = 1 + (n_words - first) // (3 + group % 8)
    places = np.arange(n_words)
    places[first:] = first + (places[first:] - first) % period
    return places


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(table(spark, sf_dir, "documents"), reorder=planted_places)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


DECONTAMINATION_SQL = r"""
    WITH d AS (
      SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), b AS (
      SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), windows AS (
      SELECT DISTINCT item, least(len(w), 10) AS n, w[s:s + least(len(w), 10) - 1] AS w
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
    ), spans AS (
      SELECT row, n, s, w[s:s + n - 1] AS w
      FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
    ), hits AS (
      SELECT row, s, n, item FROM spans JOIN windows USING (n, w)
    ), covered AS (
      SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS place FROM (SELECT DISTINCT row, s, n FROM hits)) GROUP BY row
    ), items AS (
      SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (row) LEFT JOIN items USING (row)
    """


@query("op12_decontamination", DECONTAMINATION_SQL)
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
