"""Cleaning: names, reshape, calendar and price joins, flags, profiles and the daily roll-up."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelry.functions.expressions import WEEKEND, exact, flag, is_in, missing, percent_where, total, weighted_mean
from panelry.operators.duplicates import duplicate_rows  # noqa: F401

# The keys of the daily roll-up.
DAILY_KEYS = [
    "date", "store_id", "state_id", "cat_id", "weekday", "wday", "month", "year", "event_name_1",
    "event_type_1", "event_name_2", "event_type_2", "snap_ca", "is_event", "is_weekend",
]


def snake_columns(df: DataFrame) -> DataFrame:
    """Rename every column to snake_case; repeated names get a number.

    ``%`` and ``#`` become words, runs of capitals end before the last (``HTTPCode`` is ``http_code``), and a name
    that starts with a digit or is empty gets an ``x`` in front.
    """
    names: list[str] = []
    for original in df.columns:
        worded = original.replace("%", "_percent_").replace("#", "_number_")
        split = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", worded)
        base = re.sub(r"[^0-9a-z]+", "_", split.lower()).strip("_")
        base = base if base[:1].isalpha() else f"x{base}"
        name, copies = base, 1
        while name in names:
            copies += 1
            name = f"{base}_{copies}"
        names.append(name)
    return df.toDF(*names)


def scope_store(df: DataFrame, store_id: str) -> DataFrame:
    """Keep one store. Apply it before a reshape or roll-up, so that no other store is shuffled."""
    return df.where(F.col("store_id") == store_id)


def unpivot_daily_sales(
    df: DataFrame, prefix: str = "d_", name: str = "d", value: str = "sales"
) -> DataFrame:
    """Wide day columns to one row per series and day.

    One array per row and a generator over it: a thousand day columns cost one pass over the row,
    where a projection per column would compile and copy the row a thousand times. Narrow, no shuffle.
    The two arrays are parsed from text, one call each instead of one per column.
    """
    days = [column for column in df.columns if column.startswith(prefix)]
    keys = [column for column in df.columns if column not in days]
    values = F.expr("array(" + ", ".join(f"`{day}`" for day in days) + ")")
    labels = F.expr("array(" + ", ".join(f"'{day}'" for day in days) + ")")
    return df.select(*keys, F.posexplode(values).alias("_at", value)).select(
        *keys, F.element_at(labels, F.col("_at") + 1).alias(name), value
    )


def join_calendar(df: DataFrame, calendar: DataFrame, on: str = "d") -> DataFrame:
    """Attach calendar columns by day.

    The calendar has one row per day, so the optimizer broadcasts it by its size; a calendar above
    the broadcast threshold is shuffled instead.
    """
    return df.join(calendar, on, "left")


def join_prices(
    df: DataFrame, prices: DataFrame, keys: Sequence[str] = ("store_id", "item_id", "wm_yr_wk")
) -> DataFrame:
    """Attach the weekly price; a week without a price keeps a null.

    The price side is unique on the keys and the fact has at most seven days per key, so the shuffle
    on the full key stays even however popular one item is.
    """
    return df.join(prices, list(keys), "left")


def add_row_flags(df: DataFrame, revenue: bool = True) -> DataFrame:
    """Event and weekend flags and, on fact rows, revenue (null when the price is unknown)."""
    columns = {
        "is_event": flag(F.col("event_name_1").isNotNull() | F.col("event_name_2").isNotNull()),
        "is_weekend": flag(is_in("weekday", WEEKEND)),
    }
    if revenue:
        columns["revenue"] = F.col("sales") * F.col("sell_price")
    return df.withColumns(columns)


#: From so many columns on, the missing values are counted by column number instead of one aggregate per column.
WIDE_COLUMNS = 100


def _missing_in_wide(df: DataFrame) -> DataFrame:
    """Column number, missing values and rows of a wide table: a flag per cell, counted before the shuffle."""
    tests = [f"`{name}` is null" + (f" or isnan(`{name}`)" if dtype in ("double", "float") else "") for name, dtype in df.dtypes]
    flags = F.expr("array(" + ", ".join(tests) + ")")
    counted = df.select(F.posexplode(flags).alias("_at", "_is")).groupBy("_at").agg(
        F.count_if("_is").alias("_missing"), F.count(F.lit(1)).alias("_rows")
    )
    every = df.sparkSession.range(len(tests)).select(F.col("id").cast("int").alias("_at"))
    names = F.expr("array(" + ", ".join("'" + name.replace("'", "\\'") + "'" for name in df.columns) + ")")
    return every.join(counted, "_at", "left").select(
        F.element_at(names, F.col("_at") + 1).alias("variable"), F.coalesce("_missing", F.lit(0)).cast("long").alias("missing"),
        F.round(F.try_divide(F.col("_missing") * 100.0, F.col("_rows")), 2).alias("percent"),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing count and percentage of every column, in one pass over the table; the percentage of an empty table is null."""
    if len(df.columns) >= WIDE_COLUMNS:
        return _missing_in_wide(df)
    tests = [(name, missing(name, dtype)) for name, dtype in df.dtypes]
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(test).alias(f"_{i}") for i, (_, test) in enumerate(tests)]
    )
    entries = [
        F.struct(
            F.lit(name).alias("variable"),
            F.col(f"_{i}").alias("missing"),
            F.round(F.try_divide(F.col(f"_{i}") * 100.0, F.col("_rows")), 2).alias("percent"),
        )
        for i, (name, _) in enumerate(tests)
    ]
    return counts.select(F.inline(F.array(*entries)))


def sales_profile(df: DataFrame) -> DataFrame:
    """Rows, items, stores, date range and missing dates and prices of the fact table.

    Distinct items and stores come from a roll-up by (store, item), which stays small and is combined
    before the shuffle; counting both distinct sets directly would expand every row three times.
    """
    by_pair = df.groupBy("store_id", "item_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("lo"),
        F.max("date").alias("hi"),
        F.count_if(F.col("date").isNull()).alias("no_date"),
        F.count_if(F.col("sell_price").isNull()).alias("no_price"),
    )
    return by_pair.agg(
        F.sum("rows").alias("rows"),
        F.count_distinct("item_id").alias("items"),
        F.count_distinct("store_id").alias("stores"),
        F.min("lo").alias("min_date"),
        F.max("hi").alias("max_date"),
        F.sum("no_date").alias("missing_dates"),
        F.sum("no_price").alias("missing_prices"),
        F.round(F.try_divide(F.sum("no_price") * 100.0, F.sum("rows")), 2).alias("missing_price_pct"),
    )


def price_missing_summary(df: DataFrame) -> DataFrame:
    """Sales of rows with and without a price."""
    return df.groupBy(F.col("sell_price").isNull().alias("price_missing")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("sales") == 0).alias("zero_sales_rows"),
        F.count_if(F.col("sales") > 0).alias("positive_sales_rows"),
        total("sales").alias("total_units_sold"),
        F.avg("sales").alias("average_units_sold"),
    )


def price_missing_by_month(df: DataFrame) -> DataFrame:
    """Rows without a price per calendar month."""
    no_price = F.col("sell_price").isNull()
    return (
        df.groupBy(F.trunc("date", "month").alias("year_month"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(no_price).alias("missing_prices"),
            F.round(percent_where(no_price), 2).alias("missing_price_pct"),
        )
        .orderBy("year_month")
    )


def daily_category_sales(
    df: DataFrame, keys: Sequence[str] = tuple(DAILY_KEYS), one_row_per_item: bool = False
) -> DataFrame:
    """Daily units, revenue, sales-weighted price and number of items sold.

    The price weight of a row is its sales, at least 1. ``one_row_per_item`` states that each item
    has at most one row per group: items sold are then counted in the partial aggregate. Otherwise the rows of an item
    are added up first, without a shuffle where they lie together by item and some of the keys.
    """
    weight = F.greatest(F.col("sales"), F.lit(1.0))
    sold = F.col("sales") > 0
    if one_row_per_item:
        return df.groupBy(*keys).agg(
            F.sum("sales").alias("units_sold"),
            total("revenue").alias("revenue"),
            weighted_mean("sell_price", weight).alias("average_price"),
            F.count(F.when(sold, F.col("item_id"))).alias("active_items"),
        )
    per_item = df.groupBy(*keys, "item_id").agg(
        F.sum("sales").alias("_units"),
        F.sum("revenue").alias("_revenue"),
        F.sum(F.col("sell_price") * weight).alias("_value"),
        F.sum(F.when(F.col("sell_price").isNotNull(), weight)).alias("_weight"),
        F.max(sold).alias("_sold"),
    )
    return per_item.groupBy(*keys).agg(
        F.sum("_units").alias("units_sold"),
        total("_revenue").alias("revenue"),
        F.try_divide(F.sum("_value"), F.sum("_weight")).alias("average_price"),
        F.count(F.when(F.col("_sold"), F.col("item_id"))).alias("active_items"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; empty when the keys are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def product_summary(df: DataFrame, days: int | Column | None = None) -> DataFrame:
    """Per product: total, mean, median, zero-sales percentage, active days and mean price.

    ``days`` completes a sparse table: each product then counts as having that many days, the days
    without a row being zero-sales days. Nothing is densified for it. The median comes from counts
    per distinct sales value (combined before the shuffle), so a product with a third of all rows
    still arrives as a short list of values. Sales must not be negative when ``days`` is given.
    """
    keys = ["item_id", "dept_id", "cat_id"]
    known = F.col("sales").isNotNull()
    values = df.groupBy(*keys, "sales").agg(
        F.count(F.lit(1)).alias("n"), F.sum(exact("sell_price")).alias("price_sum"), F.count("sell_price").alias("price_n")
    )
    product = Window.partitionBy(*keys)
    seen = F.sum(F.when(known, F.col("n"))).over(product)
    size = seen if days is None else F.lit(days).cast("long")
    ranked = values.withColumns(
        {
            "_size": size,
            "_zeros": size - seen,
            "_upto": F.sum(F.when(known, F.col("n"))).over(product.orderBy("sales").rowsBetween(Window.unboundedPreceding, 0)),
        }
    )

    def at(position):
        """Sales value at a zero-based position of the sorted days, implicit zeros first."""
        reached = F.min(F.when(known & (F.col("_zeros") + F.col("_upto") > position), F.col("sales")))
        return F.when(F.max("_zeros") > F.max(position), F.lit(0.0)).otherwise(reached)

    low = F.floor((F.col("_size") - 1) / 2)
    high = F.floor(F.col("_size") / 2)
    rows = F.max("_size")
    active = F.coalesce(F.sum(F.when(F.col("sales") > 0, F.col("n"))), F.lit(0))
    zero = F.coalesce(F.sum(F.when(F.col("sales") == 0, F.col("n"))), F.lit(0)) + F.max("_zeros")
    units = total(F.col("sales") * F.col("n"))
    return ranked.groupBy(*keys).agg(
        units.alias("total_sales"),
        F.try_divide(units, rows).alias("average_daily_sales"),
        ((at(low) + at(high)) / 2).alias("median_daily_sales"),
        F.try_divide(zero * 100.0, rows).alias("zero_sales_pct"),
        active.cast("long").alias("active_days"),
        F.try_divide(F.sum("price_sum").cast("double"), F.sum("price_n")).alias("average_price"),
    )
