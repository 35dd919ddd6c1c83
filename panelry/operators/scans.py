"""Moving windows and fills over one long order, in two levels and without a window that lacks a key.

The order is cut into blocks of equal width. Every block is summed up to one row; the few block rows are scanned
as one array, and each block then works on its own from what the blocks before or after it hand over. A
moving window gets the last rows of the block before it as a halo.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

#: Width of a block in units of the order: days for dates, seconds for timestamps, one for numbers.
WIDTH = 1024
#: Rows of a block of a moving window, at least; a block holds the window's halo whole.
BLOCK_ROWS = 1024


def _position(df: DataFrame, order: str) -> Column:
    kind = dict(df.dtypes)[order]
    if kind == "date":
        return F.unix_date(order).cast("long")
    if kind.startswith("timestamp"):
        return F.unix_seconds(F.col(order).cast("timestamp"))
    return F.floor(order).cast("long")


def _with_block(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_block", F.floor(_position(df, order) / F.lit(width)))


def _scanned(blocks: DataFrame, summary: str, before: Callable[[Column], Column]) -> DataFrame:
    """(block, carried): ``before`` of the summaries of all earlier blocks, in their order.

    One row holds all block summaries; their number is the length of the order over the width.
    """
    rows = blocks.agg(F.array_sort(F.collect_list(F.struct(F.col("_block").alias("b"), F.col(summary).alias("s")))).alias("rows"))
    # In blocks of blocks this would go deeper; a column of arrays is enough for some ten thousand blocks.
    each = F.transform("rows", lambda row, i: F.struct(row["b"].alias("_block"), before(F.slice("rows", F.lit(1), i)).alias("_carried")))
    return rows.select(F.explode(each).alias("e")).select("e.*")


def with_fills(df: DataFrame, order: str, value: Column, last: str, following: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the last known ``value`` at or before each row, and the first at or after it.

    Takes one row per value of ``order`` and no nulls in it. Columns ``last`` and ``following`` are null where no value is known on that side.
    """
    dealt = _with_block(df, order, width).withColumn("_value", value)
    known = F.col("_value").isNotNull()
    sums = dealt.groupBy("_block").agg(
        F.max_by("_value", F.when(known, F.col(order))).alias("_last"), F.min_by("_value", F.when(known, F.col(order))).alias("_first")
    )
    found = lambda rows: F.filter(rows, lambda row: row["s"].isNotNull())
    earlier = _scanned(sums, "_last", lambda rows: F.try_element_at(found(rows), F.lit(-1))["s"])
    # The blocks after a block are the blocks before it in the reversed order.
    later = _scanned(sums.withColumn("_block", -F.col("_block")), "_first", lambda rows: F.try_element_at(found(rows), F.lit(-1))["s"])
    carried = earlier.join(later.select((-F.col("_block")).alias("_block"), F.col("_carried").alias("_ahead")), "_block")
    inside = Window.partitionBy("_block").orderBy(order)
    here = F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    there = F.first("_value", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    filled = dealt.withColumns({"_here": here, "_there": there}).join(carried, "_block", "left")
    return filled.select(
        *df.columns, F.coalesce("_here", "_carried").alias(last), F.coalesce("_there", "_ahead").alias(following)
    )


def with_row_numbers(df: DataFrame, order: str, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the number of each row in the order, from 0. Equal values of ``order`` get their numbers in any order."""
    dealt = _with_block(df, order, width)
    # Always true, and asks for every column: the count then shares the exchange of ``df`` instead of reading its tables again.
    row = F.xxhash64(*df.columns) >= F.lit(-(2**63))
    counts = dealt.groupBy("_block").agg(F.count_if(row).alias("_n"))
    starts = _scanned(counts, "_n", lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda total, row: total + row["s"]))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(order)) - 1
    return dealt.withColumn("_inside", inside).join(starts, "_block", "left").select(
        *df.columns, (F.col("_carried") + F.col("_inside")).alias(name)
    )


def with_moving(
    df: DataFrame, order: str, rows: int, columns: Callable[[WindowSpec], dict[str, Column]], width: int = WIDTH, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` with ``columns`` of the window over the current and the ``rows`` - 1 rows before it.

    Rows are numbered along the order and dealt into blocks of equal length; each block also gets the ``rows`` - 1
    rows before its first, as many as there are.
    """
    length = max(block_rows, rows)
    numbered = with_row_numbers(df, order, "_row", width)
    block = F.floor(F.col("_row") / F.lit(length))
    # The last rows of a block are the halo of the next.
    halo = F.col("_row") % length >= length - (rows - 1)
    dealt = numbered.withColumn("_in", F.explode(F.when(halo, F.array(block, block + 1)).otherwise(F.array(block)))).withColumn("_own", F.col("_in") == block)
    frame = Window.partitionBy("_in").orderBy("_row").rowsBetween(1 - rows, 0)
    made = columns(frame)
    return dealt.withColumns(made).where("_own").select(*df.columns, *made)
