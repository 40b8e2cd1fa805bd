"""Sharding: jump consistent hashing maps stable keys to shards without a ring table.

The published algorithm (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm"): a 64-bit linear
congruential sequence seeded by the key jumps ahead through ever larger shard counts; the last jump below the number
of shards is the shard. With one shard more, a key either stays or moves to the new shard.

Defined results: a null text has no bytes and the checksum of the empty text. A null doc_id has a key of its own.
Rows equal in doc_id share a shard and have slots of their own. Texts are taken whole. An empty table gives no rows.
Columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaloom.llm._common import cut, numbered, ship, table

#: Fixed value: the multiplier of the published algorithm's generator.
MULTIPLIER = 2862933555777941757
#: Bytes a stored row has besides its text.
ROW_BYTES = 8


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each unsigned 64-bit key; at most ``shards`` rounds over the whole array."""
    key, at, ahead = keys.astype(np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a stable key of any type: its 64-bit hash goes to the jump."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return run(F.xxhash64(key))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless within its shard), grown_shard (with one shard more)."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size")
    placed = docs.select("doc_id", size, F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = cut(placed.select("*", shard_of(F.col("doc_id"), shards).alias("shard"), shard_of(F.col("doc_id"), shards + 1).alias("grown_shard")))
    # Rows of one doc_id, null ones too, are spread by their texts and sizes as well.
    out = numbered(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.struct("doc_id", "text_crc32", "size"), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jump_shards": op8_jump_shards}
ORACLE: dict[str, str] = {}
