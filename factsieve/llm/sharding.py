"""Placement of documents on shards by a lookup table that the shards fill in turns.

Each shard has an order of preference over the slots of a prime-sized table: an offset and a step,
both hashed from its name. The shards take turns, each claiming the first slot of its order
that is still free, until the table is full. So every shard has the same number of slots, give
or take one, and when a shard is lost few slots change hands besides its own. A document's
slot is a hash of its key; the table is broadcast, its size being a parameter, and placing a
document is one lookup.

Rows without a key are placed by a hash of their text, so that they do not share a slot; null
texts count as empty. Repeated rows go to the same shard. An empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime well above the number of shards; the table has so many entries.
SLOTS = 65537
LARGEST = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's place in ``shards`` for every slot; the names must differ, their order does not matter."""
    if not _is_prime(slots) or slots > LARGEST:
        raise ValueError("the number of slots must be a prime up to 2**20")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards need distinct names, at least one and no more than slots")
    turns = sorted(range(len(shards)), key=shards.__getitem__)
    at = {k: xxhash.xxh64_intdigest(shards[k], 1) % slots for k in turns}
    step = {k: xxhash.xxh64_intdigest(shards[k], 2) % (slots - 1) + 1 for k in turns}
    table, free = [-1] * slots, slots
    while free:
        for k in turns:
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    by_text = F.xxhash64(F.coalesce(text, F.lit("")))
    return F.pmod(F.when(key.isNull(), by_text).otherwise(F.xxhash64(key.cast("string"))), F.lit(slots))


def _table(docs: DataFrame, slot: str, shard: str, shards: list[str], slots: int) -> DataFrame:
    names = pd.DataFrame({slot: range(slots), shard: [shards[k] for k in lookup_table(shards, slots)]})
    return docs.sparkSession.createDataFrame(names, f"{slot} long, {shard} string")


def place(docs: DataFrame, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """One row per document row: doc_id, slot, shard."""
    keyed = docs.select("doc_id", slot_of(F.col("doc_id"), F.col("text"), slots).alias("slot"))
    return keyed.join(F.broadcast(_table(docs, "slot", "shard", shards, slots)), "slot").select("doc_id", "slot", "shard")


def write(docs: DataFrame, shards: list[str], path: str, slots: int = SLOTS, rows_per_file: int = 1_000_000) -> None:
    """Write the documents as Parquet, one folder per shard, all columns kept.

    The rows of a shard are dealt to several files by a hash, so no task writes a whole shard.
    """
    own = "_slot" + "_" * max(len(c) for c in docs.columns)
    shard = "shard" if "shard" not in docs.columns else own + "shard"
    found = _table(docs, own, shard, shards, slots)
    parts = max(1, -(-docs.count() // (len(shards) * rows_per_file)))
    placed = docs.withColumn(own, slot_of(F.col("doc_id"), F.col("text"), slots)).join(F.broadcast(found), own).drop(own)
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    placed.repartition(F.col(shard), salt).write.partitionBy(shard).parquet(path)
