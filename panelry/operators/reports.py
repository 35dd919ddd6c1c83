"""Parameterised report queries over the stored panel, feature, forecast and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelry.functions.expressions import iso_weekday, percent_label, weekday_name
from panelry.operators.evaluation import OVERALL
from panelry.operators.exploration import linear_fit

# Report column lists and labels.
MISSINGNESS_FEATURES = [
    "lag_1", "lag_7", "lag_14", "lag_28", "rolling_mean_7", "rolling_mean_14", "rolling_mean_28",
    "rolling_sd_7", "rolling_sd_28", "average_price", "price_change_1", "rolling_price_mean_28",
]
FEATURE_TABLE_COLUMNS = [
    "date", "cat_id", "units_sold", "lag_1", "lag_7", "lag_28", "rolling_mean_7", "rolling_mean_28",
    "rolling_sd_28", "calendar_month", "weekday_number", "is_event", "snap_ca", "average_price",
    "price_change_1",
]
ROUNDED_COLUMNS = ["rolling_mean_7", "rolling_mean_28", "rolling_sd_28", "average_price", "price_change_1"]
EVENT_DISTANCE = ["Event day", "Within 3 days", "Within 4–7 days", "More than 7 days away"]
BASELINE = "Seasonal Naive"


def filter_panel(
    df: DataFrame, start: str | None = None, end: str | None = None, category: str | None = None
) -> DataFrame:
    """Rows of a date range (both ends included) and of one category; no value means no filter."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    if category not in (None, "All"):
        df = df.where(F.col("cat_id") == category)
    return df


def filter_choices(df: DataFrame, columns: Sequence[str] = ("cat_id",)) -> DataFrame:
    """The values each filter offers, and the date range, as one small table in one pass over the data."""
    seen = df.groupBy(*columns).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    pairs = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("choice")) for c in columns],
        *[F.struct(F.lit("date").alias("field"), F.col(c).cast("string").alias("choice")) for c in ("_lo", "_hi")],
    )
    choices = seen.select(F.inline(pairs)).distinct()
    by_field = Window.partitionBy("field")
    first, last = F.min("choice").over(by_field), F.max("choice").over(by_field)
    kept = choices.select("field", "choice", first.alias("_a"), last.alias("_b"))
    return kept.where((F.col("field") != "date") | F.col("choice").isin(F.col("_a"), F.col("_b"))).select(
        "field", "choice"
    ).orderBy("field", "choice")


def overview_kpis(panel: DataFrame, products: DataFrame) -> DataFrame:
    """Total units and revenue, number of products, and the months the data covers."""
    count = products.agg(F.count(F.lit(1))).scalar()
    return panel.agg(
        F.sum("units_sold").alias("total_units"),
        F.sum("revenue").alias("total_revenue"),
        F.min("date").alias("_lo"),
        F.max("date").alias("_hi"),
    ).select(
        "total_units",
        "total_revenue",
        count.alias("product_count"),
        F.concat_ws(" – ", F.date_format("_lo", "MMM yyyy"), F.date_format("_hi", "MMM yyyy")).alias("date_range"),
    )


def category_mix(panel: DataFrame) -> DataFrame:
    return panel.groupBy("cat_id").agg(F.sum("units_sold").alias("total_units"))


def weekday_average(panel: DataFrame) -> DataFrame:
    """Mean units per weekday, in weekday order."""
    return panel.groupBy("weekday", "wday").agg(F.avg("units_sold").alias("average_units")).orderBy("wday")


def month_average(panel: DataFrame) -> DataFrame:
    return panel.groupBy("month").agg(F.avg("units_sold").alias("average_units"))


def key_findings(panel: DataFrame) -> DataFrame:
    """The category and the day with the highest units; the first by name or date on ties."""

    def leader(totals: DataFrame, finding: str, key: str, text: Column) -> DataFrame:
        first = F.min_by(F.struct(key, "units"), F.struct(-F.col("units"), F.col(key))).alias("top")
        return totals.agg(first).select("top.*").select(F.lit(finding).alias("finding"), text.alias("value"), "units")

    by_category = panel.groupBy("cat_id").agg(F.sum("units_sold").alias("units"))
    by_day = panel.groupBy("date").agg(F.sum("units_sold").alias("units"))
    return leader(by_category, "top_category", "cat_id", F.col("cat_id")).unionByName(
        leader(by_day, "peak_day", "date", F.date_format("date", "MMMM dd, yyyy"))
    )


def demand_trend(panel: DataFrame, metric: str) -> DataFrame:
    """A chosen measure per day and category."""
    return panel.groupBy("date", "cat_id").agg(F.coalesce(F.sum(metric), F.lit(0.0)).alias("metric_value"))


def monthly_category_trend(panel: DataFrame) -> DataFrame:
    return panel.groupBy(F.trunc("date", "month").alias("year_month"), "cat_id").agg(
        F.sum("units_sold").alias("total_units")
    )


def event_lift(panel: DataFrame) -> DataFrame:
    """Percent by which mean units on event days exceed other days; null when either side is missing."""
    on_event = F.avg(F.when(F.col("is_event") == 1, F.col("units_sold")))
    off_event = F.avg(F.when(F.col("is_event") == 0, F.col("units_sold")))
    lift = F.try_divide(F.col("event_mean") - F.col("non_event_mean"), F.col("non_event_mean")) * 100
    return (
        panel.agg(on_event.alias("event_mean"), off_event.alias("non_event_mean"))
        .withColumn("lift_pct", F.round(lift, 1))
        .withColumn("direction", F.when(lift >= 0, "higher").when(lift < 0, "lower"))
    )


def history_feature_long(features: DataFrame, feature: str) -> DataFrame:
    """Actual demand and one feature as two labelled series."""
    wide = features.select("date", F.col("units_sold").cast("double"), F.col(feature).cast("double").alias("feature_value"))
    label = F.when(F.col("series") == "units_sold", "Actual demand").otherwise("Historical feature")
    return wide.unpivot("date", ["units_sold", "feature_value"], "series", "value").withColumn("series", label)


def feature_linear_fit(features: DataFrame, feature: str) -> DataFrame:
    """Least-squares line of demand on one feature."""
    return linear_fit(features, "units_sold", feature)


def feature_correlation(features: DataFrame, feature: str) -> DataFrame:
    return features.agg(F.round(F.corr("units_sold", feature), 3).alias("correlation"))


def feature_group_counts(dictionary: DataFrame) -> DataFrame:
    """Number of described features per group, fewest first."""
    return dictionary.groupBy("group").agg(F.count(F.lit(1)).alias("feature_count")).orderBy("feature_count", "group")


def feature_kpis(summary: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows and series of the category feature table and the number of described features."""
    described = dictionary.agg(F.count(F.lit(1))).scalar()
    return summary.where(F.col("dataset") == "Category-level").select(
        F.col("rows").alias("category_rows"), F.col("series").alias("series_count"), described.alias("feature_count")
    )


def iso_weekday_average(features: DataFrame) -> DataFrame:
    """Mean units per ISO weekday with its name, and whether it is the highest."""
    number = iso_weekday("date")
    means = features.groupBy(number.alias("weekday_number")).agg(F.avg("units_sold").alias("average_units"))
    place = F.row_number().over(Window.orderBy(F.desc("average_units"), "weekday_number"))
    return means.select(
        "weekday_number",
        weekday_name("weekday_number").alias("weekday"),
        "average_units",
        (place == 1).alias("is_top"),
    )


def event_proximity_effect(features: DataFrame) -> DataFrame:
    """Mean units by distance to the nearest event."""
    event, near, close, far = EVENT_DISTANCE
    bucket = (
        F.when(F.col("is_event") == 1, event)
        .when(F.col("within_3_days_of_event") == 1, near)
        .when(F.col("within_7_days_of_event") == 1, close)
        .otherwise(far)
    )
    return features.groupBy(bucket.alias("event_proximity")).agg(F.avg("units_sold").alias("average_units"))


def feature_table(features: DataFrame, digits: int | None = 2) -> DataFrame:
    """The main features that exist, continuous ones rounded to ``digits`` decimals."""
    here = [name for name in FEATURE_TABLE_COLUMNS if name in features.columns]
    shown = {name: F.round(name, digits).alias(name) for name in ROUNDED_COLUMNS} if digits is not None else {}
    return features.select(*[shown.get(name, F.col(name)) for name in here])


def filter_forecasts(forecasts: DataFrame, category: str | None, models: Sequence[str]) -> DataFrame:
    """Forecast rows of one category and the chosen models."""
    return filter_panel(forecasts, category=category).where(F.col("model").isin(list(models)))


def forecast_series(forecasts: DataFrame, category: str | None, models: Sequence[str]) -> DataFrame:
    return filter_forecasts(forecasts, category, models).select("date", "cat_id", "model", "predicted")


def actual_series(forecasts: DataFrame, category: str | None, models: Sequence[str]) -> DataFrame:
    """The actual demand behind the forecasts, once per day."""
    return filter_forecasts(forecasts, category, models).select("date", "cat_id", "actual").distinct()


def forecast_kpis(metrics: DataFrame, forecasts: DataFrame, horizon: int = 28) -> DataFrame:
    """Best overall model with its WAPE, the horizon and the number of categories."""
    best = F.min_by(F.struct("model", "wape"), F.struct("wape", "rmse", "mae", "model"))
    categories = forecasts.agg(F.count_distinct("cat_id")).scalar()
    return metrics.where(F.col("cat_id") == OVERALL).agg(best.alias("b")).select(
        F.col("b.model").alias("best_model"),
        percent_label("b.wape").alias("best_wape"),
        F.lit(f"{horizon} days").alias("forecast_horizon"),
        categories.alias("category_count"),
    )


def baseline_improvement(metrics: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Percent by which each category's best model cuts the baseline's WAPE; null when that is 0."""
    best = F.min_by(F.struct("model", "wape", "mae", "forecast_bias"), F.struct("wape", "rmse", "mae", "model"))
    base = F.max(F.when(F.col("model") == baseline, F.col("wape")))
    gain = F.try_divide(F.col("baseline_wape") - F.col("b.wape"), F.col("baseline_wape")) * 100
    return metrics.groupBy("cat_id").agg(best.alias("b"), base.alias("baseline_wape")).select(
        "cat_id",
        F.col("b.model").alias("best_model"),
        F.round("b.wape", 2).alias("best_wape"),
        F.round("b.mae", 1).alias("best_mae"),
        F.round("b.forecast_bias", 2).alias("best_bias"),
        "baseline_wape",
        F.round(gain, 1).alias("improvement_pct"),
    )


def metric_comparison(metrics: DataFrame, metric: str, category: str | None = None) -> DataFrame:
    """One chosen metric per model."""
    return filter_panel(metrics, category=category).select("cat_id", "model", F.col(metric).alias("metric_value"))


def model_recommendation(rankings: DataFrame) -> DataFrame:
    """The first-ranked model of each category and the direction of its bias."""
    bias = F.col("forecast_bias")
    direction = F.when(bias > 0, "overforecast").when(bias < 0, "underforecast").otherwise("remain unbiased")
    return rankings.where(F.col("model_rank") == 1).select(
        "cat_id",
        F.col("model").alias("recommended_model"),
        percent_label("wape").alias("wape"),
        F.round("rmse", 1).alias("rmse"),
        direction.alias("bias_direction"),
        percent_label("forecast_bias").alias("forecast_bias"),
    )


def metrics_table(metrics: DataFrame, category: str | None = None) -> DataFrame:
    """Metrics formatted for reading: percentages with two decimals, units with one."""
    units = ["mae", "rmse", "mean_actual", "mean_predicted"]
    return filter_panel(metrics, category=category).select(
        "cat_id",
        "model",
        "observations",
        *[F.round(name, 1).alias(name) for name in units],
        *[percent_label(name).alias(name) for name in ("wape", "forecast_bias")],
    )


def residual_series(residuals: DataFrame, category: str | None, models: Sequence[str]) -> DataFrame:
    return filter_forecasts(residuals, category, models).select("date", "cat_id", "model", "residual")


def residual_boxplot(residuals: DataFrame) -> DataFrame:
    """Quartiles of the residuals per category and model; whiskers end at the last point within 1.5 IQR.

    A group has one row per day of the horizon.
    """
    group = Window.partitionBy("cat_id", "model")
    quartiles = F.percentile("residual", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(group)
    q1, q2, q3 = (F.col("_q")[i] for i in range(3))
    reach = 1.5 * (q3 - q1)
    value = F.col("residual")
    inside = (value >= q1 - reach) & (value <= q3 + reach)
    return residuals.withColumn("_q", quartiles).groupBy("cat_id", "model").agg(
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(q1).alias("q1"),
        F.max(q2).alias("median"),
        F.max(q3).alias("q3"),
        F.max(F.when(inside, value)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def residual_insight(residuals: DataFrame) -> DataFrame:
    """Mean residual and largest error per category and model; marks the mean nearest to zero."""
    means = residuals.groupBy("cat_id", "model").agg(
        F.avg("residual").alias("mean_residual"), F.max("absolute_error").alias("largest_absolute_error")
    )
    place = F.row_number().over(Window.partitionBy("cat_id").orderBy(F.abs("mean_residual"), "model"))
    return means.withColumn("closest_to_zero", place == 1)


def forecast_table(forecasts: DataFrame) -> DataFrame:
    """Forecast rows for reading: units with one decimal, percentage error with two."""
    return forecasts.select(
        "date",
        "cat_id",
        "model",
        "actual",
        *[F.round(name, 1).alias(name) for name in ("predicted", "residual", "absolute_error")],
        F.round("absolute_percentage_error", 2).alias("absolute_percentage_error"),
        "model_rank",
        "is_best_model",
    )


def top_importance(importance: DataFrame, k: int = 15) -> DataFrame:
    """The k features with the highest gain."""
    return importance.orderBy(F.desc("gain"), "feature").limit(k)
