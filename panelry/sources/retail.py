"""Retail views over the star-schema tables: lines, calendar, prices, facts and panels.

A store is a nation, a department a brand, a category a part type. Units are net of returned lines,
so a day whose lines all came back has zero units, and a week without a kept line has no price on
record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelry.functions.expressions import iso_week_key
from panelry.operators.cleaning import (
    add_row_flags, daily_category_sales, join_calendar, snake_columns,
)
from panelry.operators.features import dense_values, densify
from panelry.sources.io import read_table

# Our synthetic event calendar, (month, day) -> (name, type).
EVENTS = {
    (12, 25): ("Christmas", "National"),
    (1, 1): ("NewYear", "National"),
    (7, 4): ("IndependenceDay", "National"),
    (2, 14): ("ValentinesDay", "Cultural"),
    (10, 31): ("Halloween", "Cultural"),
}


# Schemas of the tables read here.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its known schema: no job to read file footers before the query starts."""
    return read_table(spark, f"{sf_dir}/{name}.parquet", "parquet", SCHEMAS[name])


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store number, store and state: one row per nation."""
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("store_no"), F.col("n_name").alias("store_id"), F.col("r_name").alias("state_id")
        )
    )


def numbered_lines(spark: SparkSession, sf_dir: str, store: str | None = None) -> DataFrame:
    """One row per sales line: store number, item, date, net units and the unit price of a kept line.

    The store travels as a number; names are attached after a roll-up, so that no shuffle carries them.
    With ``store``, lines of other stores go before any roll-up. Prices are in whole cents.
    """
    kept = F.col("l_returnflag") != "R"
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("store_no"))
    if store is not None:
        wanted = table(spark, sf_dir, "nation").where(F.col("n_name") == store).select(F.col("n_nationkey").alias("store_no"))
        suppliers = suppliers.join(wanted, "store_no", "left_semi")
    return (
        table(spark, sf_dir, "lineitem")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "store_no",
            F.col("l_partkey").alias("item_id"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.when(kept, F.col("l_quantity")).otherwise(0.0).alias("units"),
            F.when(kept, cents).alias("unit_price"),
        )
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines with store and state names."""
    return numbered_lines(spark, sf_dir).join(stores(spark, sf_dir), "store_no").drop("store_no")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_brand").alias("dept_id"),
        F.col("p_type").alias("cat_id"),
    )


def raw_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day between the first and the last sale, with mixed-case raw column names.

    The row count is the number of days in the data, whatever the volume of sales.
    """
    day = F.col("date")
    key = F.struct(F.month(day), F.dayofmonth(day))
    wday = (F.dayofweek(day) % 7 + 1).cast("int")

    def event(part: int) -> Column:
        chain = F.lit(None).cast("string")
        for (month, dom), names in EVENTS.items():
            chain = F.when(key == F.struct(F.lit(month), F.lit(dom)), names[part]).otherwise(chain)
        return chain

    carnival = (F.month(day) == 2) & (F.dayofmonth(day) == 14) & (wday == 2)
    snap = F.dayofmonth(day)
    return day_bounds(spark, sf_dir).select("lo", F.explode(F.sequence("lo", "hi")).alias("date")).select(
        "date",
        iso_week_key(day).alias("wm_yr_wk"),
        F.date_format(day, "EEEE").alias("weekday"),
        wday.alias("wday"),
        F.month(day).alias("month"),
        F.year(day).alias("year"),
        F.concat(F.lit("d_"), (F.datediff(day, F.col("lo")) + 1).cast("string")).alias("d"),
        event(0).alias("event_name_1"),
        event(1).alias("event_type_1"),
        F.when(carnival, "Carnival").alias("event_name_2"),
        F.when(carnival, "Religious").alias("event_type_2"),
        (snap <= 10).cast("int").alias("snap_CA"),
        (snap % 2 == 1).cast("int").alias("snap_TX"),
        (snap % 3 == 0).cast("int").alias("snap_WI"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snake_columns(raw_calendar(spark, sf_dir))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on record per store, item and week: the highest unit price of the week's kept lines."""
    return (
        numbered_lines(spark, sf_dir)
        .where(F.col("unit_price").isNotNull())
        .groupBy("store_no", "item_id", iso_week_key("date").alias("wm_yr_wk"))
        .agg(F.max("unit_price").alias("sell_price"))
        .join(stores(spark, sf_dir), "store_no")
        .select("store_id", "item_id", "wm_yr_wk", "sell_price")
    )


def weekly_price(df: DataFrame, *keys: str) -> DataFrame:
    """Replace the daily unit price by the price on record of the week.

    Equal to joining ``prices``, which derive from the same lines, without reading the lines again. A
    window partition holds the days of one week.
    """
    week = Window.partitionBy(*keys, "wm_yr_wk")
    return df.withColumn("sell_price", F.max("unit_price").over(week)).drop("unit_price")


def store_item_days(spark: SparkSession, sf_dir: str, store: str | None = None) -> DataFrame:
    """One row per store, item and day, with the ISO week.

    The lines are dealt once, by item and week: the days' sums, the week's prices and the items sold per day are all found
    within that partitioning, and an item of many lines spreads over its weeks.
    """
    lines = numbered_lines(spark, sf_dir, store).withColumn("wm_yr_wk", iso_week_key("date"))
    return lines.repartition("item_id", "wm_yr_wk").groupBy("store_no", "item_id", "wm_yr_wk", "date").agg(
        F.sum("units").alias("sales"), F.max("unit_price").alias("unit_price")
    )


def item_days(spark: SparkSession, sf_dir: str, store: str | None = None) -> DataFrame:
    """One row per store, item and day with department and category. After this no item has more rows than stores × days."""
    return store_item_days(spark, sf_dir, store).drop("wm_yr_wk").join(products(spark, sf_dir), "item_id")


def sales_fact(spark: SparkSession, sf_dir: str, store: str | None = None) -> DataFrame:
    """The cleaned fact table, of one store or of all: item-store days with calendar, price, flags and revenue.

    Prices and names come before the products: what the product join may have to shuffle then lacks what nobody asks for.
    """
    priced = weekly_price(store_item_days(spark, sf_dir, store), "store_no", "item_id")
    named = priced.join(stores(spark, sf_dir), "store_no").join(products(spark, sf_dir), "item_id")
    days = calendar(spark, sf_dir).drop("wm_yr_wk")
    ordered = ["date", "item_id", "sales", "dept_id", "cat_id", "wm_yr_wk", *[c for c in days.columns if c != "date"], "sell_price", "store_id", "state_id"]
    return add_row_flags(join_calendar(named, days, on="date").select(*ordered))


def sales_wide(
    spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("state_id", "cat_id"), store: str | None = None
) -> DataFrame:
    """Raw-file layout: one row per series, one zero-filled ``d_`` column per day of the data.

    The number of columns is the number of days, so only the two bounds come to the driver. A series
    is gathered from the daily sums that exist, as one value per day. With ``store``, other stores go before the sums.
    """
    bounds = day_bounds(spark, sf_dir).first()
    daily = (
        numbered_lines(spark, sf_dir, store).join(stores(spark, sf_dir), "store_no")
        .join(products(spark, sf_dir), "item_id")
        .groupBy(*keys, "date")
        .agg(F.sum("units").alias("sales"))
    )
    rows = dense_values(daily, list(keys), F.lit(bounds.lo), F.lit(bounds.hi), "sales")
    days = (bounds.hi - bounds.lo).days + 1
    return rows.selectExpr(*keys, *[f"_values[{n}] as d_{n + 1}" for n in range(days)])


def recorded_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sum of the items' prices on record (in cents) and the number of priced items change, per category and week.

    An item's price of a week is the highest of its kept lines, and stays on record until a later week has one.
    """
    kept = F.col("l_returnflag") != "R"
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100
    week = iso_week_key(F.col("l_shipdate").cast("date"))
    highest = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item_id"), week.alias("wm_yr_wk")).agg(
        F.round(F.max(F.when(kept, cents)) * 100).cast("long").alias("_cents")
    )
    weekly = highest.where(F.col("_cents").isNotNull()).join(products(spark, sf_dir).select("item_id", "cat_id"), "item_id")
    before = F.lag("_cents").over(Window.partitionBy("item_id").orderBy("wm_yr_wk"))
    return (
        weekly.withColumn("_before", before).groupBy("cat_id", "wm_yr_wk")
        .agg(F.sum(F.col("_cents") - F.coalesce("_before", F.lit(0))).alias("_rise"), F.count_if(F.col("_before").isNull()).alias("_new"))
    )


def with_recorded_price(panel: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds ``average_price``: the plain mean of the prices on record from earlier weeks, in whole cents (halves up).

    No sale of the day, nor of its week, moves it; it is null until an item of the category has been on sale.
    """
    first_of_week = F.row_number().over(Window.partitionBy("cat_id", "wm_yr_wk").orderBy("date")) == 1
    earlier = Window.partitionBy("cat_id").orderBy("wm_yr_wk").rangeBetween(Window.unboundedPreceding, -1)
    joined = panel.withColumn("_first", first_of_week).join(changes, ["cat_id", "wm_yr_wk"], "left")
    once = lambda name: F.sum(F.when(F.col("_first"), F.col(name))).over(earlier)
    totals = joined.withColumns({"_sum": once("_rise"), "_items": once("_new")})
    cents = F.expr("(2 * _sum + _items) div (2 * nullif(_items, 0))")
    return totals.withColumn("average_price", cents / 100).drop("_first", "_rise", "_new", "_sum", "_items")


def category_panel(spark: SparkSession, sf_dir: str, price: bool = True) -> DataFrame:
    """Dense category × day panel over all stores, with calendar columns and the price on record.

    Without ``price`` the column is missing, and the lines are not read for it.
    """
    days = calendar(spark, sf_dir)
    # The week goes with the date, and is named so that the items of a day need no shuffle of their own.
    daily = daily_category_sales(sales_fact(spark, sf_dir), keys=["date", "wm_yr_wk", "cat_id"]).drop("wm_yr_wk")
    lo, hi = date_bounds(spark, sf_dir)
    dense = densify(daily.drop("average_price"), ["cat_id"], lo, hi, zero=["units_sold", "revenue", "active_items"])
    dated = join_calendar(dense, days, on="date")
    priced = with_recorded_price(dated, recorded_prices(spark, sf_dir)) if price else dated
    return add_row_flags(priced, revenue=False)


def product_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item × day over all stores: net units and the highest unit price; only days with a line."""
    kept = F.col("l_returnflag") != "R"
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("item_id"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.sum(F.when(kept, F.col("l_quantity")).otherwise(0.0)).alias("sales"),
            F.max(F.when(kept, cents)).alias("unit_price"),
        )
        .join(products(spark, sf_dir), "item_id")
    )


def item_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net units per item with its category: lines are summed per item at once, and the products join the totals."""
    kept = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)
    totals = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.sum(kept).alias("sales"))
    return totals.join(products(spark, sf_dir), "item_id")


def raw_wide(spark: SparkSession, sf_dir: str, again: str = "ASIA") -> DataFrame:
    """A raw wide delivery of all stores: one row per store and department, one ``d_`` column per day, null on days without
    a line. The stores of the region ``again`` were delivered twice, so their rows repeat."""
    bounds = day_bounds(spark, sf_dir).first()
    days = (bounds.hi - bounds.lo).days + 1
    sums = numbered_lines(spark, sf_dir).join(products(spark, sf_dir), "item_id").groupBy("store_no", "dept_id", "date").agg(F.sum("units").alias("sales"))
    day = F.datediff("date", F.lit(bounds.lo))
    rows = sums.groupBy("store_no", "dept_id").agg(F.map_from_entries(F.collect_list(F.struct(day, "sales"))).alias("_days"))
    named = rows.join(stores(spark, sf_dir), "store_no").select(
        "store_id", "dept_id", "state_id", F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.try_element_at("_days", i)).alias("_values")
    )
    times = F.explode(F.when(F.col("state_id") == again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return named.withColumn("_time", times).selectExpr("store_id", "dept_id", *[f"_values[{n}] as d_{n + 1}" for n in range(days)])


def sold_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that have a line: one narrow column of the lines, made distinct before the shuffle."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id")).distinct().join(products(spark, sf_dir).select("item_id"), "item_id", "left_semi")


def category_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense category × day units: the part of the category panel that forecasting needs.

    Rolls up to item days first, so that a popular item reaches the product join as at most one row
    per day; then to category days, and densifies at most categories × days rows.
    """
    daily = product_days(spark, sf_dir).groupBy("cat_id", "date").agg(F.sum("sales").alias("units_sold"))
    lo, hi = date_bounds(spark, sf_dir)
    return densify(daily, ["cat_id"], lo, hi, zero=["units_sold"])


def priced_product_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item days with the highest weekly price of any store."""
    return weekly_price(product_days(spark, sf_dir).withColumn("wm_yr_wk", iso_week_key("date")), "item_id")


def product_panel(spark: SparkSession, sf_dir: str, selected: DataFrame) -> DataFrame:
    """Dense item × day panel of the selected products, with calendar, flags and weekly price.

    The semi-join comes before the densify, so only selected products get a row per day. The weekly
    price and all feature windows reuse the densify's partitioning by item.
    """
    chosen = product_days(spark, sf_dir).join(selected, "item_id", "left_semi")
    lo, hi = date_bounds(spark, sf_dir)
    dense = densify(chosen, ["item_id"], lo, hi, zero=["sales"], null=["unit_price"])
    dated = join_calendar(dense, calendar(spark, sf_dir), on="date")
    return add_row_flags(weekly_price(dated, "item_id"))


def day_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row with the first and the last day of the data: one aggregate for all that need the days, so its
    exchange is reused within a query."""
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))


def day_count(spark: SparkSession, sf_dir: str) -> Column:
    """Number of days the data spans, as a scalar subquery."""
    return day_bounds(spark, sf_dir).select(F.datediff("hi", "lo") + 1).scalar()


def date_bounds(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    """First and last day of the data, as fields of one scalar subquery."""
    both = day_bounds(spark, sf_dir).select(F.struct("lo", "hi")).scalar()
    return both["lo"], both["hi"]
