"""Panel features: dense days, calendar, events, sales history and prices.

Every window is partitioned by series and ordered by date. A panel has one row per series and day, so
a window partition never holds more rows than there are days, however large the table is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelry.functions.expressions import flag, iso_weekday, missing, percent_where
from panelry.operators.scans import with_fills
from panelry.sources.contracts import require_columns

# Feature windows and the distance that stands for "no event known".
LAGS = [1, 7, 14, 28]
MEAN_WINDOWS = [7, 14, 28]
DEVIATION_WINDOWS = [7, 28]
LONG_WINDOW = 28
FAR_AWAY = 999

# Feature dictionary (feature, group, description).
FEATURE_DICTIONARY = [
    ("lag_1", "Historical demand", "Demand observed one day earlier"),
    ("lag_7", "Historical demand", "Demand observed seven days earlier"),
    ("lag_14", "Historical demand", "Demand observed fourteen days earlier"),
    ("lag_28", "Historical demand", "Demand observed twenty-eight days earlier"),
    ("rolling_mean_7", "Rolling demand", "Mean demand during the previous seven days"),
    ("rolling_mean_14", "Rolling demand", "Mean demand during the previous fourteen days"),
    ("rolling_mean_28", "Rolling demand", "Mean demand during the previous twenty-eight days"),
    ("rolling_sd_7", "Rolling demand", "Demand variability during the previous seven days"),
    ("rolling_sd_28", "Rolling demand", "Demand variability during the previous twenty-eight days"),
    ("zero_sales_rate_28", "Demand intermittency", "Share of the previous twenty-eight days with zero sales"),
    ("calendar_month", "Calendar", "Numeric calendar month"),
    ("calendar_week", "Calendar", "ISO calendar week"),
    ("calendar_quarter", "Calendar", "Calendar quarter"),
    ("weekday_number", "Calendar", "Day of the week, with Monday equal to one"),
    ("month_sin", "Calendar", "Cyclical sine encoding of month"),
    ("month_cos", "Calendar", "Cyclical cosine encoding of month"),
    ("weekday_sin", "Calendar", "Cyclical sine encoding of weekday"),
    ("weekday_cos", "Calendar", "Cyclical cosine encoding of weekday"),
    ("is_month_start", "Calendar", "Indicates the first day of a month"),
    ("is_month_end", "Calendar", "Indicates the final day of a month"),
    ("is_event", "Events", "Indicates a recorded holiday or special event"),
    ("days_since_event", "Events", "Number of days since the most recent event"),
    ("days_until_event", "Events", "Number of days until the next event"),
    ("within_3_days_of_event", "Events", "Indicates dates within three days of an event"),
    ("snap_ca", "External factor", "Indicates a California SNAP purchasing day"),
    ("price_change_1", "Pricing", "Difference from the previous observed price"),
    ("price_pct_change_1", "Pricing", "Percentage change from the previous observed price"),
    ("is_price_decrease", "Pricing", "Indicates that price decreased from the previous day"),
    ("rolling_price_mean_28", "Pricing", "Mean historical price during the previous twenty-eight days"),
    ("price_relative_to_28_day_mean", "Pricing", "Current price divided by its prior twenty-eight-day mean"),
]


def _day_ranges(df: DataFrame, keys: Sequence[str], first_day: Column, last_day: Column) -> DataFrame:
    """Adds ``_start`` and ``_stop``: the days each row stands for once its series has a row on every day."""
    series = Window.partitionBy(*keys).orderBy("date")
    start = F.when(F.lag("date").over(series).isNull(), F.least(first_day, F.col("date"))).otherwise(F.col("date"))
    until = F.coalesce(F.date_sub(F.lead("date").over(series), 1), F.greatest(last_day, F.col("date")))
    stop = F.greatest(until, F.col("date"))  # a repeated day ends on itself
    return df.withColumns({"_start": start, "_stop": stop})


def densify(
    df: DataFrame,
    keys: Sequence[str],
    first_day: Column,
    last_day: Column,
    zero: Sequence[str] = (),
    null: Sequence[str] = (),
) -> DataFrame:
    """One row per series and day: each row also emits the empty days up to the next row of its series.

    ``zero`` measures become 0 on the added days and ``null`` measures become null; other columns are
    constant per series and carry over. One shuffle on the series key, which the feature windows then
    reuse; no join against a day table.
    """
    filled = _day_ranges(df, keys, first_day, last_day).select(
        *df.columns, F.explode(F.sequence("_start", "_stop")).alias("_day")
    )
    observed = F.col("_day") == F.col("date")
    values = {name: F.when(observed, F.col(name)).otherwise(F.lit(0)) for name in zero}
    values |= {name: F.when(observed, F.col(name)) for name in null}
    return filled.select(
        *[
            F.col("_day").alias("date") if name == "date" else values.get(name, F.col(name)).alias(name)
            for name in df.columns
        ]
    )


def dense_values(
    df: DataFrame, keys: Sequence[str], first_day: Column, last_day: Column, value: str, name: str = "_values"
) -> DataFrame:
    """One row per series with the values of all its days in order, 0.0 on days without a row: what ``densify`` gives, gathered.

    Only rows that exist are shuffled, sorted and gathered. The empty days enter afterwards, within the series' own row,
    so nothing on disk grows with the number of days. The rows are few against what they become, so the series are dealt to
    four tasks per core, however few bytes they have by then (a wide row costs each task about a second to compile).
    """
    day, zeros = F.col("date"), lambda n: F.array_repeat(F.lit(0.0), n)
    dealt = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
    ranged = _day_ranges(dealt, keys, first_day, last_day).select(
        *keys, "date", F.col(value).cast("double").alias("_value"),
        F.datediff(day, "_start").alias("_before"), F.datediff("_stop", day).alias("_after"),
        (F.abs(F.datediff("_stop", "_start")) + 1).alias("_all"),
    )
    gathered = ranged.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("date", "_value", "_before", "_after", "_all"))).alias("_rows")
    )

    def run(row: Column) -> Column:
        dated = F.concat(zeros(row["_before"]), F.array(row["_value"]), zeros(row["_after"]))
        return F.when(row["date"].isNull(), zeros(row["_all"])).otherwise(dated)  # a row without a date holds no day's value

    return gathered.select(*keys, F.flatten(F.transform("_rows", run)).alias(name))


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    """Fifteen calendar fields of a date column."""
    day = F.col(date)
    month, weekday = F.month(day), iso_weekday(day)
    quarter_start = F.trunc(day, "quarter")
    turn = 2 * F.pi()
    return df.withColumns(
        {
            "calendar_year": F.year(day),
            "calendar_month": month,
            "calendar_week": F.weekofyear(day),
            "calendar_quarter": F.quarter(day),
            "day_of_month": F.dayofmonth(day),
            "day_of_year": F.dayofyear(day),
            "weekday_number": weekday,
            "is_month_start": flag(F.dayofmonth(day) == 1),
            "is_month_end": flag(day == F.last_day(day)),
            "is_quarter_start": flag(day == quarter_start),
            "is_quarter_end": flag(day == F.last_day(F.add_months(quarter_start, 2))),
            "month_sin": F.sin(turn * month / 12),
            "month_cos": F.cos(turn * month / 12),
            "weekday_sin": F.sin(turn * weekday / 7),
            "weekday_cos": F.cos(turn * weekday / 7),
        }
    )


def event_calendar(panel: DataFrame) -> DataFrame:
    """Distance of each day to the last and the next event day.

    The days are made distinct first; both fills run in blocks of the order that hand over their last and first event.
    """
    event_day = F.when(F.col("is_event") == 1, F.col("date"))
    since, until = F.col("days_since_event"), F.col("days_until_event")

    def within(days: int) -> Column:
        return flag((F.coalesce(since, F.lit(FAR_AWAY)) <= days) | (F.coalesce(until, F.lit(FAR_AWAY)) <= days))

    days = panel.select("date", "is_event").distinct()
    filled = with_fills(days, "date", event_day, "_last_event", "_next_event")
    return filled.select(
        "date",
        F.datediff("date", "_last_event").alias("days_since_event"),
        F.datediff("_next_event", "date").alias("days_until_event"),
    ).withColumns({"within_3_days_of_event": within(3), "within_7_days_of_event": within(7)})


def join_event_calendar(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Attach event distances by day; the day table is small and the optimizer checks its size."""
    return panel.join(events, "date", "left")


def sales_history_features(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Series index, lags and rolling statistics of the days before the current one.

    A rolling value over k days appears from the k-th row of a series on; the frame excludes the
    current day, so at the k-th row it holds k-1 values. All windows share one shuffle and one sort.
    """
    series = Window.partitionBy(*keys).orderBy("date")
    value = F.col(target)

    def before(days: int, aggregate) -> Column:
        enough = F.row_number().over(series) >= days
        return F.when(enough, aggregate.over(series.rowsBetween(-days, -1)))

    columns = {"series_day_index": F.row_number().over(series)}
    columns |= {f"lag_{n}": F.lag(value, n).over(series) for n in LAGS}
    columns |= {f"rolling_mean_{n}": before(n, F.avg(value)) for n in MEAN_WINDOWS}
    columns |= {f"rolling_sd_{n}": before(n, F.stddev_samp(value)) for n in DEVIATION_WINDOWS}
    columns["rolling_min_7"] = before(7, F.min(value))
    columns["rolling_max_7"] = before(7, F.max(value))
    columns[f"zero_sales_rate_{LONG_WINDOW}"] = before(LONG_WINDOW, F.avg((value == 0).cast("double")))
    return df.withColumns(columns).withColumns(
        {
            "difference_from_lag_7": F.col("lag_1") - F.col("lag_7"),
            "difference_from_mean_28": F.col("lag_1") - F.col("rolling_mean_28"),
        }
    )


def price_features(df: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    """Price changes and the price relative to its mean over the previous 28 days.

    Same partitioning and order as the sales history, so both run on one shuffle.
    """
    series = Window.partitionBy(*keys).orderBy("date")
    now, previous = F.col(price), F.col("previous_price")
    change, usual = F.col("price_change_1"), F.col(f"rolling_price_mean_{LONG_WINDOW}")
    prior_mean = F.avg(now).over(series.rowsBetween(-LONG_WINDOW, -1))
    first = df.withColumns(
        {
            "price_missing": flag(now.isNull()),
            "previous_price": F.lag(now).over(series),
            f"rolling_price_mean_{LONG_WINDOW}": F.when(F.row_number().over(series) >= LONG_WINDOW, prior_mean),
        }
    )
    return first.withColumn("price_change_1", now - previous).withColumns(
        {
            "price_pct_change_1": F.when(previous != 0, change / previous),
            "is_price_decrease": flag(change < 0),
            "is_price_increase": flag(change > 0),
            "price_relative_to_28_day_mean": F.when(usual != 0, now / usual),
        }
    )


def with_history_flag(df: DataFrame) -> DataFrame:
    """1 on rows that have the 28-day lag and the 28-day mean."""
    return df.withColumn(
        "has_complete_sales_history", flag(F.col("lag_28").isNotNull() & F.col("rolling_mean_28").isNotNull())
    )


def model_ready(features: DataFrame) -> DataFrame:
    """Rows with a full sales history."""
    return features.where(F.col("has_complete_sales_history") == 1)


def build_features(
    panel: DataFrame, events: DataFrame, keys: Sequence[str], target: str, price: str
) -> DataFrame:
    """All feature groups on a dense panel, in model-table form (before the history filter)."""
    require_columns(panel, [*keys, "date", target, price], "panel")
    with_days = join_event_calendar(calendar_features(panel), events)
    with_sales = sales_history_features(with_days, keys, target)
    return with_history_flag(price_features(with_sales, keys, price))


def category_features(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Category-level features."""
    return build_features(panel, events, ["cat_id"], "units_sold", "average_price")


def product_features(sales: DataFrame, events: DataFrame) -> DataFrame:
    """Product-level features of the selected products."""
    return build_features(sales, events, ["item_id"], "sales", "sell_price")


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def feature_validation(features: DataFrame, key: str, target: str, price: str | None = None) -> DataFrame:
    """Rows, series, dates and missing values of a model-ready feature table."""
    entries = [
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(key).alias("series"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.count_if(F.col(target).isNull()).alias("missing_target"),
        F.count_if(F.col("lag_28").isNull()).alias("missing_lag_28"),
        F.count_if(F.col("rolling_mean_28").isNull()).alias("missing_rolling_mean_28"),
    ]
    if price:
        entries += [
            F.count_if(F.col(price).isNull()).alias("missing_prices"),
            F.round(percent_where(F.col(price).isNull()), 2).alias("missing_price_pct"),
        ]
    return features.agg(*entries)


def leakage_check(features: DataFrame, target: str) -> DataFrame:
    """Correlation of the target with its one-day lag and its prior seven-day mean."""
    return features.agg(
        F.corr(target, "lag_1").alias("correlation_target_lag_1"),
        F.corr(target, "rolling_mean_7").alias("correlation_target_rolling_7"),
    )


def feature_summary(category: DataFrame, product: DataFrame) -> DataFrame:
    """Size and date range of the two feature tables; a table's features are its columns less one."""

    def describe(label: str, df: DataFrame, key: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct(key).alias("series"),
            F.min("date").alias("minimum_date"),
            F.max("date").alias("maximum_date"),
        ).select(
            F.lit(label).alias("dataset"), "rows", "series",
            F.lit(len(df.columns) - 1).alias("feature_count"), "minimum_date", "maximum_date",
        )

    return describe("Category-level", category, "cat_id").unionByName(describe("Product-level", product, "item_id"))


def feature_dictionary(spark) -> DataFrame:
    """The described features as a relation."""
    return spark.createDataFrame(FEATURE_DICTIONARY, "feature string, group string, description string")


def feature_missingness(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Missing percentage of the named columns that exist: one aggregate row, turned into rows."""
    types = dict(features.dtypes)
    here = [name for name in names if name in types]
    shares = features.agg(*[percent_where(missing(name, types[name])).alias(name) for name in here])
    return shares.unpivot([], here, "feature", "missing_pct")
