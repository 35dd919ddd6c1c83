"""Distinct counts that roll up: bitmaps of item numbers, built once and merged to coarser periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def item_bitmaps(df: DataFrame, item: str, levels: Sequence[Sequence[str]]) -> DataFrame:
    """One row per group of a level and bucket of item numbers: the keys of all levels (null where not of this one), ``level``
    (its place in ``levels``), ``bucket`` and ``bits``.

    A bucket holds 32,768 item numbers in 4 KB. The bitmaps are built before the shuffle, and rows of one group and bucket
    merge, so the table's size follows groups × buckets, not rows. Item numbers must be whole and not negative; null items don't count.
    """
    keys = list(dict.fromkeys(key for level in levels for key in level))
    known = df.where(F.col(item).isNotNull()).select(
        *keys, F.call_function("bitmap_bucket_number", item).alias("bucket"), F.call_function("bitmap_bit_position", item).alias("_bit")
    )
    sets = [[F.col(k) for k in level] + [F.col("bucket")] for level in levels]
    held = known.groupingSets(sets, *keys, "bucket").agg(F.call_function("bitmap_construct_agg", F.col("_bit")).alias("bits"), F.grouping_id().alias("_set"))
    numbers = {sum((key not in level) << (len(keys) - i) for i, key in enumerate(keys)): n for n, level in enumerate(levels)}
    level = F.element_at(F.create_map(*[F.lit(v) for pair in numbers.items() for v in pair]), F.col("_set").cast("int"))
    return held.select(*keys, level.alias("level"), "bucket", "bits")


def distinct_items(bitmaps: DataFrame, level: int, key: Column, name: str, count: str = "active_items") -> DataFrame:
    """(``name``, ``count``): exact numbers of distinct items per value of ``key``, a column or a coarser function of one of the level's keys."""
    merged = bitmaps.where(F.col("level") == level).groupBy(key.alias(name), "bucket").agg(F.call_function("bitmap_or_agg", F.col("bits")).alias("bits"))
    return merged.groupBy(name).agg(F.sum(F.call_function("bitmap_count", F.col("bits"))).alias(count))
