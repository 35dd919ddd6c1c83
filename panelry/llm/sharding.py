"""Shards by jump consistent hashing: the key and the number of shards decide, without a ring table."""

from __future__ import annotations

import pandas as pd
import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelry.llm.shared import numbered

# The multiplier of the published jump hash.
_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; with one more shard, a key stays or moves to the new one.

    All keys jump side by side; about the logarithm of ``shards`` rounds are needed.
    """
    key = keys.astype(np.uint64)
    here = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        here[moving] = ahead[moving]
        k = key[moving] * _STEP + np.uint64(1)
        key[moving] = k
        scale = float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[moving] = ((here[moving] + 1) * scale).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return here


def shard_of(key: Column, shards: int) -> Column:
    """Shard number of a long key. A null key counts as 0."""

    @F.pandas_udf("int")
    def jump(ids: pd.Series) -> pd.Series:
        mixed = ids.to_numpy(np.int64).view(np.uint64)
        return pd.Series(jump_hash(mixed, shards), dtype="int32")

    # Jump hashing expects spread-out keys; consecutive ids are not.
    return jump(F.xxhash64(F.coalesce(key, F.lit(0).cast("long"))))


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every document with its shard, its place there, and its shard if there were one shard more.

    Law ``key``: doc_id and the shard count decide, so equal texts spread and a hot source or group of copies
    fills no shard. Size is the UTF-8 bytes of the text plus 1; a null or empty text has size 1 and checksum 0.
    A null doc_id counts as 0. Repeated rows are placed one by one, in any order. Other columns are not read.
    """
    rows = docs.count()
    named = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).select(
        "doc_id",
        (F.octet_length("text").cast("long") + 1).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    placed = numbered(named, ["shard"], [F.col("doc_id")], rows, "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
