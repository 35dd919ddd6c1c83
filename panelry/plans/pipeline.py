"""The batch stages over raw files: clean, explore, build features, forecast.

Each stage reads what the previous one wrote, so a stage can be repeated alone and no lineage spans
more than one stage.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from panelry.operators import boosting, checks, cleaning, ets, evaluation, exploration, features, naive
from panelry.sources import contracts
from panelry.sources.io import read_table, write_table

# Schema of the stored daily roll-up.
DAILY_SCHEMA = (
    "date date, store_id string, state_id string, cat_id string, weekday string, wday int, month int, year int, "
    "event_name_1 string, event_type_1 string, event_name_2 string, event_type_2 string, snap_ca int, is_event int, "
    "is_weekend int, units_sold double, revenue double, average_price double, active_items long"
)
HORIZON = 28


def sales_schema(spark: SparkSession, path: str) -> str:
    """Schema of a wide sales file from its header line: text keys, a number per day column."""
    names = spark.read.text(path).first()[0].replace('"', "").split(",")
    return ", ".join(f"`{n}` {'string' if n in contracts.SALES_KEYS else 'double'}" for n in names)


def clean(spark: SparkSession, raw_dir: str, out_dir: str, store_id: str) -> None:
    """Raw calendar, wide sales and prices to the fact table and the daily category roll-up of one store."""
    calendar = cleaning.snake_columns(read_table(spark, f"{raw_dir}/calendar.csv", schema=contracts.CALENDAR_SCHEMA))
    sales_path = f"{raw_dir}/sales_train_evaluation.csv"
    sales = cleaning.snake_columns(read_table(spark, sales_path, schema=sales_schema(spark, sales_path)))
    prices = cleaning.snake_columns(read_table(spark, f"{raw_dir}/sell_prices.csv", schema=contracts.PRICE_SCHEMA))

    long = cleaning.unpivot_daily_sales(cleaning.scope_store(sales, store_id))
    fact = cleaning.add_row_flags(cleaning.join_prices(cleaning.join_calendar(long, calendar), prices))
    write_table(fact, f"{out_dir}/sales_complete.parquet")

    stored = read_table(spark, f"{out_dir}/sales_complete.parquet")
    daily = cleaning.daily_category_sales(stored)
    write_table(daily, f"{out_dir}/daily_category_sales.csv")


def explore(spark: SparkSession, out_dir: str, selected: int = 100) -> None:
    """Product summary, and the sales of the products with the highest totals."""
    fact = read_table(spark, f"{out_dir}/sales_complete.parquet")
    write_table(cleaning.product_summary(fact).orderBy(F.desc("total_sales")), f"{out_dir}/product_summary.csv")
    top = exploration.select_top_products(fact, selected)
    chosen = exploration.selected_product_sales(fact, top, contracts.PRODUCT_SALES_COLUMNS)
    write_table(chosen, f"{out_dir}/selected_product_sales.parquet")


def build_features(spark: SparkSession, out_dir: str) -> None:
    """Category and product feature tables, their summary and the feature dictionary."""
    daily = read_table(spark, f"{out_dir}/daily_category_sales.csv", schema=DAILY_SCHEMA)
    daily = contracts.ensure_price_column(daily)
    products = read_table(spark, f"{out_dir}/selected_product_sales.parquet")
    contracts.require_columns(products, contracts.PRODUCT_SALES_COLUMNS, "product sales")
    checks.check_unique(daily, ["cat_id", "date"])
    checks.check_unique(products, ["item_id", "date"])

    events = features.event_calendar(daily)
    by_category = features.model_ready(features.category_features(daily, events))
    by_product = features.model_ready(features.product_features(products, events))
    write_table(by_category, f"{out_dir}/category_features.parquet")
    write_table(by_product, f"{out_dir}/product_features.parquet")
    summary = features.feature_summary(
        read_table(spark, f"{out_dir}/category_features.parquet"), read_table(spark, f"{out_dir}/product_features.parquet")
    )
    write_table(summary, f"{out_dir}/feature_summary.csv")
    write_table(features.feature_dictionary(spark), f"{out_dir}/feature_dictionary.csv")


def forecast(
    spark: SparkSession, out_dir: str, store_id: str, trees: int | None = None, spread: int | None = None
) -> None:
    """Fit and compare the three models on the holdout; store forecasts, metrics, ranks and importance."""
    ready = read_table(spark, f"{out_dir}/category_features.parquet")
    contracts.require_columns(ready, contracts.MODEL_INPUT_COLUMNS, "category features")
    checks.check_series(ready)
    train, test = evaluation.train_test_split(ready, HORIZON)
    checks.check_split(train, test, HORIZON)

    names = boosting.gbt_predictors(ready)
    model = boosting.fit_gbt(train, names, trees=trees)
    forecasts = [
        naive.seasonal_naive_forecast(train, HORIZON),
        ets.ets_forecast(ets.ets_selection(train, spread=spread), HORIZON),
        boosting.gbt_forecast(model, test, names),
    ]
    write_table(evaluation.all_forecasts(forecasts, test), f"{out_dir}/forecast_errors.parquet")
    errors = read_table(spark, f"{out_dir}/forecast_errors.parquet")
    checks.check_forecasts(errors, test, len(forecasts))

    metrics = evaluation.all_model_metrics(errors)
    rankings = evaluation.model_rankings(evaluation.category_model_metrics(errors))
    ranked = evaluation.forecasts_with_rank(errors, rankings)
    write_table(metrics, f"{out_dir}/category_model_metrics.csv")
    write_table(rankings, f"{out_dir}/category_model_rankings.csv")
    write_table(ranked.orderBy("cat_id", "model", "date"), f"{out_dir}/category_forecasts.csv")
    write_table(evaluation.category_residuals(ranked), f"{out_dir}/category_residuals.csv")
    write_table(boosting.gbt_importance(model, train, names), f"{out_dir}/feature_importance.csv")
    write_table(evaluation.forecast_metadata(train, test, errors, store_id, HORIZON), f"{out_dir}/forecasting_metadata.csv")
