"""Exploratory aggregates over the daily panel and the product table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelry.functions.expressions import exact, percent_where
from panelry.operators.scans import with_moving
from panelry.sources.io import materialize


def daily_total(panel: DataFrame) -> DataFrame:
    """Units and revenue per day."""
    return panel.groupBy("date").agg(F.sum("units_sold").alias("units"), F.sum("revenue").alias("revenue"))


def with_moving_average(daily: DataFrame, days: int = 30, value: str = "units", name: str = "ma30") -> DataFrame:
    """Moving average over the current and the previous rows, null until ``days`` rows exist.

    Takes one row per day. The order is cut into blocks with a halo of ``days`` - 1 rows, so no task sees it whole.
    """
    return with_moving(
        daily, "date", days, lambda frame: {name: F.when(F.count(F.lit(1)).over(frame) == days, F.avg(value).over(frame))}
    )


def daily_total_ma30(panel: DataFrame, days: int = 30) -> DataFrame:
    """Daily totals with their 30-day moving average. Aggregates first, so the windows see days only."""
    return with_moving_average(daily_total(panel), days)


def monthly_seasonality(panel: DataFrame) -> DataFrame:
    return panel.groupBy("year", "month").agg(F.sum("units_sold").alias("units"))


def category_summary(panel: DataFrame) -> DataFrame:
    return panel.groupBy("cat_id").agg(
        F.sum("units_sold").alias("total_sales"),
        F.sum("revenue").alias("total_revenue"),
        F.avg("units_sold").alias("avg_daily_sales"),
    )


def weekday_totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy("weekday", "wday").agg(F.sum("units_sold").alias("sales"))


def _flag_effect(panel: DataFrame, flag_column: str, label: str, yes: str, no: str) -> DataFrame:
    return (
        panel.groupBy(flag_column)
        .agg(F.avg("units_sold").alias("average_units"))
        .withColumn(label, F.when(F.col(flag_column) == 1, yes).otherwise(no))
    )


def event_effect(panel: DataFrame) -> DataFrame:
    """Mean units on event days and on other days."""
    return _flag_effect(panel, "is_event", "event_status", "Event day", "Non-event day")


def snap_effect(panel: DataFrame) -> DataFrame:
    """Mean units on SNAP days and on other days."""
    return _flag_effect(panel, "snap_ca", "snap_status", "SNAP day", "Non-SNAP day")


def price_demand_points(fact: DataFrame) -> DataFrame:
    """Price and units of the rows whose price is known."""
    return fact.where(F.col("sell_price").isNotNull()).select("sell_price", "sales")


def price_demand_curve(fact: DataFrame, width: float) -> DataFrame:
    """Price bins of a fixed width: rows and mean price and units per bin.

    The bin is computed on the price in ``width`` units, so the group count follows the price range,
    not the rows.
    """
    return (
        price_demand_points(fact)
        .groupBy(F.floor(F.col("sell_price") / width).cast("long").alias("price_bin"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            (F.sum(exact("sell_price")).cast("double") / F.count(F.lit(1))).alias("average_price"),
            F.avg("sales").alias("average_units"),
        )
    )


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` over complete pairs, in one aggregate."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.agg(
        F.count_if(both).alias("pairs"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def price_demand_fit(fact: DataFrame) -> DataFrame:
    """Linear trend of units on price."""
    return linear_fit(price_demand_points(fact), "sales", "sell_price")


def product_totals(fact: DataFrame) -> DataFrame:
    return fact.groupBy("item_id").agg(F.sum("sales").alias("total_sales"))


def top_k_with_ties(df: DataFrame, value: str, k: int) -> DataFrame:
    """Rows whose value is at least the k-th largest; ties at the k-th place all stay.

    The k-th value is a scalar from a distributed top-k. A rank over the whole table would sort it in
    one task.
    """
    kth = df.orderBy(F.desc(value)).limit(k).agg(F.min(value)).scalar()
    return df.where(F.col(value) >= kth)


def top_k_strict(df: DataFrame, value: str, k: int, tie_break: str) -> DataFrame:
    """Exactly k rows; the tie-break column makes the choice repeatable."""
    return df.orderBy(F.desc(value), tie_break).limit(k)


def top_products(fact: DataFrame, k: int = 10) -> DataFrame:
    return top_k_with_ties(product_totals(fact), "total_sales", k)


def top_products_per_category(fact: DataFrame, k: int = 10) -> DataFrame:
    """Top k products of each category, ties kept.

    The rank filter is applied before the shuffle as well (a partial group limit), so a category with
    a third of the products sends only its leaders to the final rank.
    """
    totals = fact.groupBy("item_id", "cat_id").agg(F.sum("sales").alias("total_sales"))
    place = F.rank().over(Window.partitionBy("cat_id").orderBy(F.desc("total_sales")))
    return totals.withColumn("_rank", place).where(F.col("_rank") <= k).drop("_rank")


def select_top_products(fact: DataFrame, k: int = 100) -> DataFrame:
    """Ids of the top k products with ties, written out: a small table with a known size."""
    return materialize(top_products(fact, k).select("item_id"), "top-products")


def selected_product_sales(fact: DataFrame, selected: DataFrame, columns: list[str]) -> DataFrame:
    """Fact rows of the selected products.

    The optimizer broadcasts ``selected`` when its written size allows and otherwise splits skewed
    products in the shuffle join.
    """
    return fact.join(selected, "item_id", "left_semi").select(*columns)


def intermittency_histogram(products: DataFrame, bins: int = 40) -> DataFrame:
    """Number of products per equal-width bin of the zero-sales percentage (0 to 100)."""
    width = 100.0 / bins
    index = F.least(F.floor(F.col("zero_sales_pct") / width), F.lit(bins - 1)).cast("int")
    return (
        products.groupBy(index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("products"))
        .select("bin", (F.col("bin") * width).alias("from_pct"), ((F.col("bin") + 1) * width).alias("to_pct"), "products")
    )
