"""Sharding by a permutation-filled lookup table (consistent placement in constant time)."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import hash60
from .places import field, quoted, whole

TABLE_SIZE = 65_537
N_SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:15], 16)


@lru_cache(maxsize=16)
def lookup_table(shards: tuple[str, ...], size: int = TABLE_SIZE) -> tuple[int, ...]:
    """For each of `size` slots (a prime) the index of its shard.

    Each shard prefers the slots offset, offset + skip, offset + 2 * skip, ... (mod size), a permutation as the size is
    prime. The shards take turns; at its turn a shard claims the first slot of its order that is still free. So the
    shares differ by one slot at most, and when a shard goes, few slots of the others change hands.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime, at least the number of shards")
    at = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    left = size
    while left:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            owner[at[k]] = k
            left -= 1
            if not left:
                break
    return tuple(owner)


def lookup_frame(spark: SparkSession, shards: tuple[str, ...], size: int = TABLE_SIZE) -> DataFrame:
    """The table as rows (slot, shard), read from one literal: its length is the parameter `size`, whatever the input."""
    owners = ",".join(map(str, lookup_table(shards, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")).select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot; a null key counts as the empty string."""
    return F.pmod(hash60(F.coalesce(key.cast("string"), F.lit(""))), F.lit(size)).cast("long")


def shard_names(n: int) -> tuple[str, ...]:
    return tuple(f"shard-{k:05d}" for k in range(n))


def assign_shards(df: DataFrame, key_col: str = "doc_id", shards: Sequence[str] | int = N_SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """`df` with shard_slot and shard (index in `shards`, a number of shards or their names).

    Equal keys go to one shard, also null keys (as the empty string) and repeated rows; keys may be of any type that has a
    text form. The rows aren't shuffled: the broadcast table holds `size` rows. Columns shard_slot and shard of `df`, if
    any, are replaced; all others stay, whatever their names. An empty table gives an empty result.
    """
    names = shard_names(shards) if isinstance(shards, int) else tuple(shards)
    table = lookup_frame(df.sparkSession, names, size).select(F.col("slot").alias("_at"), F.col("shard").alias("_shard"))
    rows = df.select(whole(df), slot_of(quoted(key_col), size).alias("_slot"))
    found = rows.join(F.broadcast(table), F.col("_slot") == F.col("_at"), "left")
    own = [c for c in df.columns if c.lower() not in ("shard_slot", "shard")]
    return found.select(*[field(c).alias(c) for c in own], F.col("_slot").alias("shard_slot"), F.col("_shard").alias("shard"))


def write_shards(df: DataFrame, path: str, **how) -> None:
    """Write `df` under `path`/shard=K/, null keys and repeated rows too; an empty table leaves an empty folder. Rows are dealt by shard with large shards split over tasks (a rebalance, which
    Spark sizes as it runs), so a hot shard makes several files rather than one large task."""
    placed = df if "shard" in df.columns else assign_shards(df, **how)
    placed.hint("rebalance", "shard").write.partitionBy("shard").mode("overwrite").parquet(path)
