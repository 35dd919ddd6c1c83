"""As-of join of two tables: every row gets the last entry of its key before it, by one sweep of both in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

#: Width of a block in units of the (whole) order column.
WIDTH = 256


def asof_join(
    rows: DataFrame, entries: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], width: int = WIDTH, inclusive: bool = False,
) -> DataFrame:
    """``rows`` with ``values`` of the latest entry of the same keys whose ``at`` is smaller (or equal, if ``inclusive``).

    Both tables meet in blocks of (keys, at // width). A block is swept on its own; what stands before it comes from the last
    entries of the blocks, one row a block, scanned per key. So a key with a third of all rows is as many tasks as it has blocks.
    ``at`` is whole in both. Rows without an earlier entry, with a null key or a null ``at`` keep null values; of entries that
    share keys and ``at`` the greatest counts. Rows are kept as they are, repeated ones too.
    """
    keys, names = list(keys), rows.columns
    entry = F.struct(*values)
    known = F.col(at).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    last = entries.where(known).groupBy(*keys, F.col(at).alias("_at")).agg(F.max(entry).alias("_entry"))
    asked = rows.select(*keys, F.col(at).alias("_at"), F.lit(None).cast(last.schema["_entry"].dataType).alias("_entry"), F.struct(*names).alias("_row"))
    marked = last.select(*keys, "_at", "_entry", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    both = asked.unionByName(marked).withColumn("_block", F.floor(F.col("_at") / F.lit(width)))
    # At equal times an entry stands after the rows it must not reach, or before those it may.
    entries_first = F.col("_row").isNotNull() if inclusive else F.col("_row").isNull()
    sweep = Window.partitionBy(*keys, "_block").orderBy(F.col("_at"), entries_first).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_here", F.last("_entry", ignorenulls=True).over(sweep)).where("_row is not null")
    # One row per key and block, of either table: what the blocks before it end with.
    ends = last.groupBy(*keys, F.floor(F.col("_at") / F.lit(width)).alias("_block")).agg(F.max_by("_entry", "_at").alias("_end"))
    blocks = ends.unionByName(swept.select(*keys, "_block").distinct(), allowMissingColumns=True).groupBy(*keys, "_block").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    joined = swept.select(*keys, "_block", "_here", "_row").join(carried, [*keys, "_block"], "left")
    found = F.coalesce("_here", "_carried")
    return joined.select(*[F.col(f"_row.{c}").alias(c) for c in names], *[found[v].alias(v) for v in values])
