"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Each shard has its own permutation of the slots of a prime-sized table (an
offset and a skip taken from its name's hash). Shards take turns, each claiming
the first slot of its permutation that is still free, until the table is full:
shards own nearly equal shares, and a shard's removal moves little else. The
table has a fixed number of rows and is broadcast; a row is placed by one hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 4093                # a prime; a hundred slots or more for each shard
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def _hash(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[str]:
    """Slot -> shard (driver; its size is a parameter, not data)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    at = [_hash(s, "offset") % slots for s in shards]
    skip = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    table: list[str | None] = [None] * slots
    free = slots
    while True:
        for i, shard in enumerate(shards):
            while table[at[i]] is not None:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = shard
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of its MD5 modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with columns ``slot`` and ``shard`` (columns of these names are replaced).

    A null key goes where the empty text goes; equal keys share a shard, so a
    key that is unique per row spreads any hot group. No shuffle: the table is
    broadcast, its size fixed by ``slots``.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot long, shard string")
    placed = rows.drop("shard").withColumn("slot", slot_of(F.col(key), slots))
    return placed.join(F.broadcast(table), "slot")


def placements(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, slot, shard)`` of every row of ``docs``; a null text has 0 bytes."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(rows).select("doc_id", "n_bytes", "slot", "shard")


def write_shards(docs: DataFrame, path: str, files_per_shard: int = 8, key: str = "doc_id", **options) -> None:
    """Write ``docs`` with one folder a shard; a shard's rows are dealt to several tasks."""
    placed = place(docs, key, **options)
    dealt = placed.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns]), F.lit(files_per_shard)))
    dealt.repartition("shard", "_part").drop("_part", "slot").write.partitionBy("shard").parquet(path)


def placements_sql() -> str:
    rows = ", ".join(f"({i}, '{s}')" for i, s in enumerate(lookup_table()))
    return f"""
WITH table_(slot, shard) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(d.slot AS BIGINT) AS slot, shard FROM d JOIN table_ USING (slot)"""
