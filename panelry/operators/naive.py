"""Seasonal naive forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def seasonal_naive_forecast(
    train: DataFrame,
    horizon: int = 28,
    season: int = 7,
    key: str = "cat_id",
    target: str = "units_sold",
    label: str = "Seasonal Naive",
) -> DataFrame:
    """Repeat the last training season of each series over the horizon.

    Each of the last ``season`` days emits its own forecast days, so the forecast needs no join. A
    series has at most one row per day, which bounds the window.
    """
    latest = Window.partitionBy(key).orderBy(F.desc("date"))
    age = F.row_number().over(latest)
    last_day = F.max("date").over(Window.partitionBy(key))
    tail = train.select(key, "date", target, age.alias("_age"), last_day.alias("_end")).where(F.col("_age") <= season)
    steps = F.sequence(F.lit(season) - F.col("_age") + 1, F.lit(horizon), F.lit(season))
    reachable = F.lit(season) - F.col("_age") + 1 <= horizon
    return tail.where(reachable).select(
        key, F.col(target).alias("_value"), "_end", F.explode(steps).alias("_step")
    ).select(
        F.date_add("_end", F.col("_step")).alias("date"),
        key,
        F.lit(label).alias("model"),
        F.greatest(F.col("_value").cast("double"), F.lit(0.0)).alias("predicted"),
    )
