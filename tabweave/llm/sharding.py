"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a prime-sized table, an arithmetic
progression from two hashes of its name. The shards take turns, each claiming its most preferred
free slot, until the table is full; so shares differ by one slot at most, and a change of the shard
list moves few slots. A row's key is hashed to a slot and looked up in the broadcast table, whose
size is fixed (65,537 rows), whatever the data or the number of shards.

Defined cases: a null key is placed as the empty string. Equal keys, and so repeated rows, go to one
shard; a key that holds a large share of the rows is spread by naming more key columns (``salt``).
Text is only measured, null as 0 bytes. An input column named like an output is replaced (after it
has served as a key). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

TABLE_SIZE = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The slots' shard numbers (positions in ``shards``). ``size`` must be prime, so that every progression visits all slots."""
    if not _is_prime(size):
        raise ValueError(f"table size {size} isn't prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and no more than slots")
    place = [_hash("offset " + s) % size for s in shards]
    step = [_hash("step " + s) % (size - 1) + 1 for s in shards]
    table = [-1] * size
    left = size
    while True:
        for k in range(len(shards)):
            at = place[k]
            while table[at] >= 0:
                at = (at + step[k]) % size
            table[at] = k
            place[k] = (at + step[k]) % size
            left -= 1
            if not left:
                return table


def slot(keys: list[Column], size: int = TABLE_SIZE) -> Column:
    """A row's slot, by the first 60 bits of the MD5 of its key columns as text."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size


def place(
    df: DataFrame, keys: list[str], shards: list[str], salt: list[str] | None = None, size: int = TABLE_SIZE, slot_name: str = "slot", shard_name: str = "shard"
) -> DataFrame:
    """``df`` with its slot and shard number. ``salt``: more columns of the key, to spread hot keys."""
    table = lookup_table(shards, size)
    own, other = free_name(df, "slot_of_row"), free_name(df, "slot_of_table")
    slots = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")).alias(other, shard_name))
    return (
        df.withColumn(own, slot([df[c] for c in [*keys, *(salt or [])]], size))
        .drop(slot_name, shard_name)
        .join(F.broadcast(slots), F.col(own) == F.col(other))
        .withColumn(slot_name, F.col(own))
        .drop(own, other)
    )


def write(df: DataFrame, path: str, keys: list[str], shards: list[str], salt: list[str] | None = None, size: int = TABLE_SIZE) -> None:
    """Write ``df`` as Parquet under ``path``, a folder ``shard=K`` for each shard.

    Rows are dealt out by ranges of (shard, slot), so a shard is written by few tasks but one shard
    may take several.
    """
    placed = place(df, keys, shards, salt, size)
    placed.repartitionByRange("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
