"""A filter of fixed size in front of a shuffle, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelry.sources.io import materialize

#: Bits of the filter; it goes to every task as one array of 128 KB.
BITS = 1 << 20


def rows_maybe_in(rows: DataFrame, hash_of_row: Column, ids: DataFrame, hash_of_id: Column) -> DataFrame:
    """The rows whose hash may be among those of ``ids``: all that are, and few others while there are fewer ids than bits.

    With many more ids than bits all rows pass, and the join behind the filter does the work.
    """
    slot = F.pmod(hash_of_id, F.lit(BITS))
    held = ids.select(slot.alias("_slot")).groupBy((F.col("_slot") / 64).cast("int").alias("_at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_slot % 64 as int))")).alias("_bits")
    )
    every = rows.sparkSession.range(BITS // 64).select(F.col("id").cast("int").alias("_at"))
    filled = every.join(held, "_at", "left").select(F.struct("_at", F.coalesce("_bits", F.lit(0)).alias("_bits")).alias("_s"))
    bitmap = materialize(filled.agg(F.array_sort(F.collect_list("_s"))["_bits"].alias("m")), "filter").scalar()
    mine = F.pmod(hash_of_row, F.lit(BITS))
    return rows.where(F.call_function("getbit", F.get(bitmap, (mine / 64).cast("int")), (mine % 64).cast("int")) == 1)
