"""Exponential smoothing with automatic form selection.

Spark gathers each series into one row (a series never has more values than there are days), spreads
the rows and turns the chosen forms into forecasts. The parameter search of one series runs in an
Arrow-batched UDF. The same recursion as a fold over an array column was measured first: 222 s for six
series, against 7 s here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from panelry.functions import smoothing

# Ship the search with the UDF, so that workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(smoothing)

# What the search returns per series.
FIT_SCHEMA = (
    "form string, aicc double, alpha double, beta double, gamma double, phi double, "
    "level double, trend double, season array<double>, lift double, tilt double"
)


def series_rows(train: DataFrame, key: str, target: str) -> DataFrame:
    """One row per series: its values in date order, how many they are, and the last day."""
    pairs = F.array_sort(F.collect_list(F.struct("date", F.col(target).cast("double").alias("y"))))
    return (
        train.where(F.col(target).isNotNull())
        .groupBy(key)
        .agg(pairs.alias("_pairs"), F.max("date").alias("last_date"))
        .select(
            key,
            "last_date",
            F.size("_pairs").alias("observations"),
            F.transform("_pairs", lambda pair: pair["y"]).alias("values"),
        )
    )


def ets_selection(
    train: DataFrame, key: str = "cat_id", target: str = "units_sold", period: int = 7, spread: int | None = None
) -> DataFrame:
    """The best form of each series by AICc, with its parameters and final states.

    Multiplicative forms are tried on series whose values are all positive. Give ``spread`` (a number
    of tasks) when there are fewer series than cores: the gathered rows would otherwise be coalesced
    into one task. With many series leave it out; no series then travels twice. A batch sent to Python
    holds ``spark.sql.execution.arrow.maxRecordsPerBatch`` series; lower it when series are long.
    """

    @F.pandas_udf(FIT_SCHEMA)
    def fit(values: pd.Series) -> pd.DataFrame:
        empty = (None,) * 11
        found = [smoothing.fit_series(np.asarray(y, dtype=float), period) or empty for y in values]
        return pd.DataFrame(found, columns=[field.split()[0] for field in FIT_SCHEMA.split(", ")])

    rows = series_rows(train, key, target)
    if spread:
        rows = rows.repartition(spread)
    return rows.select(key, "last_date", "observations", fit("values").alias("_fit")).select(
        key, "last_date", "observations", "_fit.*"
    )


def ets_forecast(selection: DataFrame, horizon: int = 28, key: str = "cat_id", period: int = 7) -> DataFrame:
    """Point forecasts of the selected forms, not below zero."""
    step = F.col("_step")
    damped = F.col("phi") * (1 - F.pow("phi", step)) / (1 - F.col("phi"))
    reach = F.when(F.col("form").contains("Ad"), damped).otherwise(step.cast("double"))
    base = F.col("level") + reach * F.col("trend")
    effect = F.get("season", (step - 1) % period)
    predicted = (
        F.when(F.col("form").endswith("N"), base)
        .when(F.col("form").endswith("M"), base * effect)
        .otherwise(base + effect)
    )
    return selection.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        F.date_add("last_date", step).alias("date"),
        key,
        F.lit("ETS").alias("model"),
        F.greatest(predicted, F.lit(0.0)).alias("predicted"),
    )
