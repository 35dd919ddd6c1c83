"""Holdout split, checks, forecast errors, metrics and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Metric precision, the label of the overall rows and the run description.
METRIC_DIGITS = 3
OVERALL = "ALL"
EVALUATION_TYPE = "Fixed 28-day chronological holdout"
RANKING_METRIC = "WAPE"


def test_start(panel: DataFrame, horizon: int) -> Column:
    """First day of the holdout, as a scalar subquery."""
    return panel.agg(F.date_sub(F.max("date"), horizon - 1)).scalar()


def train_test_split(panel: DataFrame, horizon: int = 28) -> tuple[DataFrame, DataFrame]:
    """Chronological split: the last ``horizon`` days of the panel are the holdout."""
    start = test_start(panel, horizon)
    return panel.where(F.col("date") < start), panel.where(F.col("date") >= start)


def series_validation(panel: DataFrame, key: str = "cat_id", target: str = "units_sold") -> DataFrame:
    """Rows, dates and missing targets per series. One row per series and day, so no date set is kept."""
    per_day = panel.groupBy(key, "date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(target).isNull()).alias("gaps")
    )
    return per_day.groupBy(key).agg(
        F.sum("n").alias("rows"),
        F.count("date").alias("unique_dates"),
        F.min("date").alias("minimum_date"),
        F.max("date").alias("maximum_date"),
        F.sum("gaps").alias("missing_target"),
    )


def series_agreement(validation: DataFrame) -> DataFrame:
    """One row: are all series complete, of one length and over one date range?"""
    return validation.agg(
        F.sum("missing_target").alias("missing_target"),
        ((F.min("rows") == F.max("rows"))
         & (F.min("minimum_date") == F.max("minimum_date"))
         & (F.min("maximum_date") == F.max("maximum_date"))).alias("series_agree"),
    )


def split_validation(train: DataFrame, test: DataFrame, horizon: int, key: str = "cat_id") -> DataFrame:
    """Holdout rows per series, whether they fill the horizon, and whether train and test overlap."""
    train_end = train.agg(F.max("date")).scalar()
    return test.groupBy(key).agg(F.count(F.lit(1)).alias("test_rows"), F.min("date").alias("_from")).select(
        key,
        "test_rows",
        (F.col("test_rows") == horizon).alias("fills_horizon"),
        (train_end >= F.col("_from")).alias("train_overlap"),
    )


def all_forecasts(forecasts: list[DataFrame], test: DataFrame, target: str = "units_sold") -> DataFrame:
    """Stack the models' forecasts, attach the actual demand and compute row errors."""
    stacked = reduce(lambda a, b: a.unionByName(b), forecasts)
    return forecast_errors(stacked, test, target)


def forecast_errors(forecasts: DataFrame, test: DataFrame, target: str = "units_sold") -> DataFrame:
    """Residual, absolute, squared and percentage error; the last is null when nothing was sold."""
    actual = test.select("date", "cat_id", F.col(target).alias("actual"))
    residual, error = F.col("residual"), F.col("absolute_error")
    return (
        forecasts.join(actual, ["date", "cat_id"], "left")
        .withColumn("residual", F.col("actual") - F.col("predicted"))
        .withColumn("absolute_error", F.abs(residual))
        .withColumns(
            {
                "squared_error": residual * residual,
                "absolute_percentage_error": F.when(F.col("actual") != 0, error / F.col("actual") * 100),
            }
        )
    )


def forecast_validation(errors: DataFrame, test: DataFrame, models: int) -> DataFrame:
    """One row: expected and actual row counts and the number of missing actuals and predictions.

    Every row of the test set is expected once per model, so a series without any forecast shows.
    """
    expected = test.agg(F.count(F.lit(1))).scalar() * models
    return errors.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(expected).alias("expected_rows"),
        F.count_if(F.col("actual").isNull()).alias("missing_actual"),
        F.count_if(F.col("predicted").isNull()).alias("missing_predicted"),
    )


def metric_columns() -> list[Column]:
    """MAE, RMSE, WAPE, bias and means as aggregates over actual and predicted."""
    actual, predicted = F.col("actual"), F.col("predicted")
    miss = F.abs(actual - predicted)
    sold = F.coalesce(F.sum(actual), F.lit(0.0))
    values = {
        "mae": F.avg(miss),
        "rmse": F.sqrt(F.avg(miss * miss)),
        "wape": F.when(sold != 0, F.sum(miss) / sold * 100),
        "forecast_bias": F.when(sold != 0, F.sum(predicted - actual) / sold * 100),
        "mean_actual": F.avg(actual),
        "mean_predicted": F.avg(predicted),
    }
    return [F.count(F.lit(1)).alias("observations")] + [
        F.round(value, METRIC_DIGITS).alias(name) for name, value in values.items()
    ]


def category_model_metrics(forecasts: DataFrame) -> DataFrame:
    """Metrics per category and model."""
    return forecasts.groupBy("cat_id", "model").agg(*metric_columns())


def forecast_metrics(forecasts: DataFrame) -> DataFrame:
    """Metrics per model over all categories."""
    return forecasts.groupBy("model").agg(*metric_columns())


def all_model_metrics(forecasts: DataFrame) -> DataFrame:
    """Metrics per (category, model) and per model, in one pass; overall rows are labelled ``ALL``."""
    sets = [[F.col("cat_id"), F.col("model")], [F.col("model")]]
    grouped = forecasts.groupingSets(sets, "cat_id", "model").agg(
        *metric_columns(), F.grouping("cat_id").alias("_overall")
    )
    label = F.when(F.col("_overall") == 1, OVERALL).otherwise(F.col("cat_id"))
    return grouped.withColumn("cat_id", label).drop("_overall")


def overall_metrics(metrics: DataFrame) -> DataFrame:
    """The overall rows, best model first."""
    return metrics.where(F.col("cat_id") == OVERALL).orderBy("wape", "rmse", "mae", "model")


def model_rankings(metrics: DataFrame) -> DataFrame:
    """Rank models per category on the rounded metrics; the model name settles exact ties."""
    order = Window.partitionBy("cat_id").orderBy("wape", "rmse", "mae", "model")
    return metrics.withColumn("model_rank", F.row_number().over(order)).withColumn(
        "is_best_model", F.col("model_rank") == 1
    )


def best_models(rankings: DataFrame) -> DataFrame:
    return rankings.where("is_best_model").select("cat_id", "model", "mae", "rmse", "wape", "forecast_bias")


def forecasts_with_rank(errors: DataFrame, rankings: DataFrame) -> DataFrame:
    """Attach rank and best flag; ranks already present are replaced."""
    ranks = rankings.select("cat_id", "model", "model_rank", "is_best_model")
    own = [name for name in errors.columns if name not in ("model_rank", "is_best_model")]
    return errors.select(own).join(ranks, ["cat_id", "model"], "left").select(*own, "model_rank", "is_best_model")


def category_residuals(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        "date", "cat_id", "model", "actual", "predicted", "residual", "absolute_error", "squared_error",
        "absolute_percentage_error", "model_rank", "is_best_model",
    )


def forecast_metadata(
    train: DataFrame, test: DataFrame, forecasts: DataFrame, store: str, horizon: int = 28
) -> DataFrame:
    """One row that describes the run, stamped with the time it is computed."""
    spans = train.agg(
        F.min("date").alias("training_start_date"),
        F.max("date").alias("training_end_date"),
        F.count_distinct("cat_id").alias("categories"),
    )
    return spans.select(
        F.lit(store).alias("project_store"),
        F.lit(horizon).alias("forecast_horizon_days"),
        "training_start_date",
        "training_end_date",
        test.agg(F.min("date")).scalar().alias("testing_start_date"),
        test.agg(F.max("date")).scalar().alias("testing_end_date"),
        "categories",
        forecasts.agg(F.count_distinct("model")).scalar().alias("models_evaluated"),
        F.lit(EVALUATION_TYPE).alias("evaluation_type"),
        F.lit(RANKING_METRIC).alias("ranking_metric"),
        F.current_timestamp().alias("created_at"),
    )
