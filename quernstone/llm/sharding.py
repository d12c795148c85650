"""Consistent sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table, (offset + j * skip) mod size. The shards take
turns; in its turn a shard claims the first slot of its permutation that is still free. A key goes to the shard at slot
hash(key) mod size, so placement is one lookup, the load is even within a slot per shard, and when a shard leaves,
few keys of other shards move.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: Prime, over 100 times the shards; the broadcast table has this many rows of 12 bytes whatever the input.
SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """Slot -> index into shards. Depends on the names alone, not on their order in the list, but for the indices."""
    if not shards:
        raise ValueError("no shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime that is not below the number of shards")

    def number(name: str, what: str, below: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{what}:{name}".encode()).digest()[:8], "big") % below

    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at = {i: number(shards[i], "offset", size) for i in turns}
    skip = {i: number(shards[i], "skip", size - 1) + 1 for i in turns}
    table, free = [-1] * size, size
    while free:
        for i in turns:
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + skip[i]) % size
            table[slot] = i
            at[i] = (slot + skip[i]) % size
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """Slot of a key: the first 15 hex digits of the MD5 of its string form, mod size. A null key counts as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % size


def assign(df: DataFrame, key: str, shards: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """df with columns slot (long) and shard (string); existing columns of these names are replaced.

    Null keys go where '' goes; equal keys go to one shard; an empty table stays empty. Placement is row by row: the
    only exchange is the broadcast of the table, whose size is fixed by `size`. To spread one hot key over several
    shards, pass a key column that includes a row number or a hash of the row."""
    shards = SHARDS if shards is None else shards
    table = lookup_table(shards, size)
    spark = df.sparkSession
    rows = spark.createDataFrame([(i, shards[x]) for i, x in enumerate(table)], "slot long, shard string")
    return df.drop("shard").withColumn("slot", slot_of(F.col(f"`{key}`"), size)).join(F.broadcast(rows), "slot", "left")


def balance(placed: DataFrame) -> DataFrame:
    """Rows per shard."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard. Every task writes its own file to each folder, so no shard's rows meet in one task."""
    placed.write.partitionBy("shard").parquet(path)


def oracle() -> str:
    """The query in SQL, with the lookup table as a string of one character a slot: the turns of the shards themselves are
    no set operation, and the table is held against brute force in the tests."""
    filled = "".join(chr(48 + x) for x in lookup_table(SHARDS))
    return f"""
WITH s AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SIZE} AS slot FROM documents),
t AS (SELECT '{filled}' AS filled)
SELECT doc_id, slot, 'shard-' || lpad(CAST(ascii(filled[slot + 1]) - 48 AS VARCHAR), 3, '0') AS shard FROM s, t
"""
