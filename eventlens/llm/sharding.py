"""Sharding: a lookup table of prime size that the shards fill in turns.

Every shard has its own order of preference over all slots, ``(offset + j * skip) mod slots`` with offset
and skip hashed from its name. In turns each claims the next free slot of its order until none is free, so
shares differ by one slot at most, and adding a shard moves few slots between the others. The table's
size depends on parameters alone; it is broadcast, and a document's place is one lookup by the hash of
its id. A source or a group of copies may hold any share of the rows: only the id decides.

Cases: a null id is placed as the empty text; rows with the same id get the same shard; an empty table
gives an empty result. Only the id is read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 2053
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def _hashed(name: str, what: str) -> int:
    return int(hashlib.sha256(f"{what}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The position in ``shards`` of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime of at least {len(shards)}, not {slots}")
    place = [_hashed(s, "offset") % slots for s in shards]
    skip = [_hashed(s, "skip") % (slots - 1) + 1 if slots > 1 else 0 for s in shards]
    table: list[int] = [-1] * slots
    free = slots
    while True:
        for shard in range(len(shards)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + skip[shard]) % slots
            table[place[shard]] = shard
            free -= 1
            if not free:
                return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: 60 bits of the SHA-256 of its text, modulo the table's size."""
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)


def table_frame(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """slot, shard: the lookup table as rows."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ","))).select(
        F.col("pos").cast("long").alias("slot"), F.get(names, F.col("col").cast("int")).alias("shard")
    )


def assign(docs: DataFrame, id_column: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, slot, shard for every row."""
    placed = docs.select(F.col(f"`{id_column}`").alias("doc_id")).withColumn("slot", slot(F.col("doc_id"), slots))
    return placed.join(F.broadcast(table_frame(docs.sparkSession, shards, slots)), "slot").select("doc_id", "slot", "shard")


def write_shards(docs: DataFrame, path: str, id_column: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> None:
    """Every row below ``path`` in the folder of its shard. A folder's rows come from as many tasks as its slots allow."""
    if "shard" in docs.columns:
        raise ValueError("the table has a column named shard already")
    table = table_frame(docs.sparkSession, shards, slots).withColumnRenamed("slot", "__slot")
    placed = docs.withColumn("__slot", slot(F.col(f"`{id_column}`"), slots)).join(F.broadcast(table), "__slot")
    placed.repartition("shard", F.col("__slot") % 8).drop("__slot").write.partitionBy("shard").mode("overwrite").parquet(path)
