"""Every operator as a named query over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelry.operators import (
    asof, boosting, cleaning, distinct_counts, ets, ets_cells, evaluation, exploration, features, naive, reports, selection,
)
from panelry.sources import contracts, io, retail, stored

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries.
HORIZON = 28
SEASONS = {"Seasonal Naive": 7, "Seasonal Naive 14": 14, "Seasonal Naive 28": 28}
DATE_FROM, DATE_TO = "1996-01-01", "1999-12-31"
CATEGORY = "PROMO"
STORE = "NATION_3"
SELECTED = 100
HISTORY_FEATURE = "rolling_mean_7"
PRICE_WIDTH = 100.0
MONEY = {"revenue", "total_revenue", "metric_value"}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles (money sums to cents), so that results do not depend on the order of summation."""

    def rounded(name: str):
        places = 2 if name in MONEY else digits
        return (F.round(F.col(name), places) + F.lit(0.0)).alias(name)

    return df.select(*[rounded(name) if kind == "double" else F.col(name) for name, kind in df.dtypes])


# ---- shared inputs -------------------------------------------------------------------------------


def fact(spark, d):
    return retail.sales_fact(spark, d)


def panel(spark, d):
    return retail.category_panel(spark, d)


def unpriced(spark, d):
    """The category panel for questions that don't look at the price."""
    return retail.category_panel(spark, d, price=False)


def flagged_calendar(spark, d):
    return cleaning.add_row_flags(retail.calendar(spark, d), revenue=False)


def events(spark, d):
    """The dense panel has every calendar day, so its event days are the calendar's."""
    return features.event_calendar(flagged_calendar(spark, d))


def category_features(spark, d):
    return features.category_features(panel(spark, d), events(spark, d))


def ready_features(spark, d):
    return features.model_ready(category_features(spark, d))


def filtered_features(spark, d):
    return reports.filter_panel(ready_features(spark, d), category=CATEGORY)


def product_sales(spark, d):
    selected = exploration.select_top_products(retail.item_totals(spark, d), SELECTED)
    return retail.product_panel(spark, d, selected)


def product_features(spark, d):
    sales = product_sales(spark, d).select(*contracts.PRODUCT_SALES_COLUMNS)
    return features.product_features(sales, events(spark, d))


def products(spark, d):
    """Product table of the sparse item days, the missing days counted as zero-sales days."""
    return cleaning.product_summary(retail.priced_product_days(spark, d), days=retail.day_count(spark, d))


def stored_units(spark, d):
    """Category units at the stage boundary between features and forecasting."""
    return io.materialize(retail.category_units(spark, d), "units")


def stored_features(spark, d):
    """Model-ready category features at the stage boundary between features and forecasting."""
    return io.materialize(ready_features(spark, d), "features")


def naive_errors(spark, d):
    """Forecasts of the seasonal naive model at three season lengths, with actuals and errors."""
    train, test = evaluation.train_test_split(stored_units(spark, d), HORIZON)
    forecasts = [
        naive.seasonal_naive_forecast(train, HORIZON, season, label=label) for label, season in SEASONS.items()
    ]
    return evaluation.all_forecasts(forecasts, test)


def naive_metrics(spark, d):
    return evaluation.all_model_metrics(naive_errors(spark, d))


def naive_rankings(spark, d):
    return evaluation.model_rankings(evaluation.category_model_metrics(naive_errors(spark, d)))


def ranked_errors(spark, d):
    errors = io.materialize(naive_errors(spark, d), "forecasts")
    return evaluation.forecasts_with_rank(
        errors, evaluation.model_rankings(evaluation.category_model_metrics(errors))
    )


#: Boosted models of this run, by application and tables: forecast, importance and metrics derive from one fit.
_FITTED: dict = {}


def fitted_gbt(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _FITTED:
        stored = stored_features(spark, d)
        train, test = evaluation.train_test_split(stored, HORIZON)
        names = boosting.gbt_predictors(stored)
        _FITTED[key] = boosting.fit_gbt(train, names), train, test, names
    return _FITTED[key]


def parallel(spark):
    return spark.sparkContext.defaultParallelism


# ---- queries -------------------------------------------------------------------------------------


def _round_trip(spark, d, fmt):
    """Write the daily panel, read it back with its schema."""
    daily = panel(spark, d).select("date", "cat_id", "units_sold", "average_price", "event_name_1", "is_event")
    path = io.shared_path(spark, "daily") + f".{fmt}"
    io.write_table(daily, path, fmt, partition_by=["cat_id"] if fmt == "parquet" else None)
    return tidy(io.read_table(spark, path, fmt, daily.schema))


def _duplicate_rows(spark, d):
    """Repeated whole rows of the sales lines."""
    return cleaning.duplicate_rows(retail.table(spark, d, "lineitem"))


def _train_test_split(spark, d):
    train, test = evaluation.train_test_split(stored_units(spark, d), HORIZON)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _series_agreement(spark, d):
    return evaluation.series_agreement(evaluation.series_validation(stored_features(spark, d)))


def _split_validation(spark, d):
    return evaluation.split_validation(*evaluation.train_test_split(stored_features(spark, d), HORIZON), HORIZON)


def _metadata(spark, d):
    train, test = evaluation.train_test_split(stored_features(spark, d), HORIZON)
    return evaluation.forecast_metadata(train, test, naive_errors(spark, d), "ALL", HORIZON).drop("created_at")


def _feature_summary(spark, d):
    return features.feature_summary(
        ready_features(spark, d), features.model_ready(product_features(spark, d))
    )


def _described(spark, d, ready=None):
    """Feature dictionary entries with the measured missing share of each feature."""
    measured = features.feature_missingness(
        ready_features(spark, d) if ready is None else ready, [name for name, _, _ in features.FEATURE_DICTIONARY]
    )
    return features.feature_dictionary(spark).join(measured, "feature")


def _feature_kpis(spark, d):
    """From the stored feature table, which both the summary and the measured shares read."""
    stored = stored_features(spark, d)
    summary = features.feature_summary(stored, features.model_ready(product_features(spark, d)))
    return reports.feature_kpis(summary, _described(spark, d, stored))


def _ensure_price(spark, d):
    """The panel under its older price name, brought back to the current one."""
    older = panel(spark, d).select("date", "cat_id", F.col("average_price").alias("average_selling_price"))
    return tidy(contracts.ensure_price_column(older))


def _seasonal_naive(spark, d):
    train, _ = evaluation.train_test_split(stored_units(spark, d), HORIZON)
    return naive.seasonal_naive_forecast(train, HORIZON)


def _ets(spark, d):
    train, _ = evaluation.train_test_split(stored_units(spark, d), HORIZON)
    return ets.ets_selection(train, spread=parallel(spark))


#: The cell whose states are listed.
STATE_CELL = ("AAdA", 0.2, 0.05, 0.1, 0.9)


def _training_units(spark, d):
    return evaluation.train_test_split(stored_units(spark, d), HORIZON)[0]


def _ets_cells(spark, d):
    return ets_cells.ets_cells(_training_units(spark, d))


def _ets_rescored(spark, d):
    """Whether the fold gives the searched winner of each series the AICc that the search gave it."""
    train = io.materialize(_training_units(spark, d), "train")
    both = ets_cells.rescored(train, ets.ets_selection(train, spread=parallel(spark)))
    return both.select("cat_id", (F.abs(F.col("aicc") - F.col("searched_aicc")) <= 1e-6 * F.abs("aicc")).alias("agrees"))


def _gbt_forecast(spark, d):
    model, _, test, names = fitted_gbt(spark, d)
    return boosting.gbt_forecast(model, test, names)


def _gbt_importance(spark, d):
    model, train, _, names = fitted_gbt(spark, d)
    return boosting.gbt_importance(model, train, names)


def _all_models(spark, d):
    """The whole forecasting run: three models, one metric table."""
    model, train, test, names = fitted_gbt(spark, d)
    forecasts = [
        naive.seasonal_naive_forecast(train, HORIZON),
        ets.ets_forecast(ets.ets_selection(train, spread=parallel(spark)), HORIZON),
        boosting.gbt_forecast(model, test, names),
    ]
    return evaluation.all_model_metrics(evaluation.all_forecasts(forecasts, test))


def _predictors(spark, d):
    """The model frame: keys, target and the predictors the feature table has."""
    ready = ready_features(spark, d)
    return tidy(ready.select("date", "units_sold", *boosting.gbt_predictors(ready)))


def _imputed(spark, d):
    train, _ = evaluation.train_test_split(stored_features(spark, d), HORIZON)
    names = ["cat_id", "average_price", "price_relative_to_28_day_mean"]
    return tidy(boosting.median_imputed_features(train, names).select("date", *names))


def _encoded(spark, d):
    train, _ = evaluation.train_test_split(stored_features(spark, d), HORIZON)
    return tidy(boosting.encoded_features(train, boosting.gbt_predictors(train)))


def _zero_variance(spark, d):
    train, _ = evaluation.train_test_split(stored_features(spark, d), HORIZON)
    return boosting.zero_variance_columns(train, boosting.gbt_predictors(train))


def _unpivot(spark, d):
    return cleaning.unpivot_daily_sales(retail.sales_wide(spark, d))


def store_wide(spark, d):
    """The raw wide table of one store, one row per item, scoped before it is built."""
    return retail.sales_wide(spark, d, ("store_id", "item_id"), STORE)


def store_categories(spark, d):
    """Daily sales of each category in each store, as series of their own: most have days with and without sales."""
    daily = retail.item_days(spark, d).groupBy("store_no", "cat_id", "date").agg(F.sum("sales").alias("sales"))
    return daily.select(F.concat_ws("|", "store_no", "cat_id").alias("item_id"), F.lit(None).cast("string").alias("dept_id"), "cat_id", "sales", F.lit(None).cast("double").alias("sell_price"))


def _series_intermittency(spark, d):
    return exploration.intermittency_histogram(cleaning.product_summary(store_categories(spark, d), days=retail.day_count(spark, d)))


def _join_calendar(spark, d):
    """Unpivoted daily sales with the calendar attached by day label."""
    days = retail.calendar(spark, d).select("d", "date", "wm_yr_wk", "weekday", "event_name_1", "snap_ca")
    return cleaning.join_calendar(_unpivot(spark, d), days)


def _join_prices(spark, d):
    rolled = retail.numbered_lines(spark, d).groupBy("store_no", "item_id", "date").agg(F.sum("units").alias("sales"))
    named = rolled.join(retail.stores(spark, d), "store_no").select("store_id", "item_id", "date", "sales")
    keyed = named.withColumn("wm_yr_wk", retail.iso_week_key("date"))
    return tidy(cleaning.join_prices(keyed, retail.prices(spark, d)))


def _active_items(spark, d):
    """Distinct items sold per day, week, month and store, all from one stored table of bitmaps."""
    sold = retail.numbered_lines(spark, d).where("units > 0").select("store_no", "item_id", "date", F.trunc("date", "month").alias("month"))
    bitmaps = io.materialize(distinct_counts.item_bitmaps(sold, "item_id", [["date"], ["store_no", "month"]]), "bitmaps")
    day, text = F.col("date"), lambda c: c.cast("string")
    parts = [
        distinct_counts.distinct_items(bitmaps, level, key, "member").withColumn("grain", F.lit(grain))
        for grain, level, key in (
            ("day", 0, text(day)), ("week", 0, text(retail.iso_week_key("date"))), ("month", 0, F.date_format(day, "yyyy-MM")), ("store", 1, text(F.col("store_no"))),
        )
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("grain", "member", "active_items")


QUARTILES = (0.25, 0.5, 0.75)


def _price_quartiles(spark, d):
    """Exact quartiles of the lines' extended price per return flag."""
    prices = retail.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    return selection.exact_quantiles(prices, "price", QUARTILES, ["flag"])


def _selected_medians(spark, d):
    """The training median of every numeric predictor by selection, as the model's imputation uses them."""
    train = evaluation.train_test_split(stored_features(spark, d), HORIZON)[0]
    names = [name for name in boosting.gbt_predictors(train) if dict(train.dtypes)[name] != "string"]
    long = train.select([F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "feature", "value")
    return selection.exact_quantiles(long, "value", [0.5], ["feature"]).select("feature", F.col("value").alias("median"))


def _bucketed_prices(spark, d):
    """Store-item-week sales with the week's price: both tables bucketed by the key of the join."""
    keys = ["store_no", "item_id", "wm_yr_wk"]
    lines = retail.numbered_lines(spark, d).withColumn("wm_yr_wk", retail.iso_week_key("date"))
    facts = stored.bucketed(lines.groupBy("date", *keys).agg(F.sum("units").alias("sales")), "facts", keys)
    prices = stored.bucketed(lines.where("unit_price is not null").groupBy(*keys).agg(F.max("unit_price").alias("sell_price")), "prices", keys)
    return facts.join(prices, keys, "left")


def _bucketed_selection(spark, d):
    """Item days of the best products: a semi-join of two tables bucketed by item."""
    days = stored.bucketed(retail.product_days(spark, d).select("item_id", "date", "sales"), "days", ["item_id"])
    best = stored.bucketed(exploration.top_products(retail.item_totals(spark, d), SELECTED).select("item_id"), "best", ["item_id"])
    return days.join(best, "item_id", "left_semi")


def panel_by_month(spark, d):
    return stored.by_month(unpriced(spark, d).select("date", "cat_id", "units_sold", "revenue", "is_event"), label="panel")


def _pruned_panel(spark, d):
    """The chosen dates and category, from a panel stored by month: only months with a chosen date are read."""
    panel = panel_by_month(spark, d)
    dates = retail.calendar(spark, d).select("date").where(F.col("date").between(DATE_FROM, DATE_TO))
    return stored.between_days(panel, dates).where(F.col("cat_id") == CATEGORY).drop("year_month")


def _pruned_holdout(spark, d):
    """The last days of the stored panel: which ones a query over the days finds out."""
    panel = panel_by_month(spark, d)
    days = retail.calendar(spark, d).select("date")
    last = days.agg(F.max("date")).scalar()
    return stored.between_days(panel, days.where(F.col("date") > F.date_sub(last, HORIZON))).drop("year_month")


def _kept_up_rollup(spark, d):
    """Monthly sales per store, loaded from the years before 1998 and then added to: later years, and lines received late."""
    # The tables hold no day of receipt: a line is received up to six weeks after its day.
    received = F.date_add(F.col("l_shipdate").cast("date"), F.pmod(F.col("l_orderkey"), F.lit(43)).cast("int"))
    lines = retail.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").cast("date").alias("date"), received.alias("received"),
        F.col("l_quantity").alias("quantity"), F.lit(1).cast("long").alias("lines"),
    )
    rollup = stored.RollUp(io.shared_path(spark, "rollup"), ["supplier"], {"quantity": F.sum("quantity"), "lines": F.sum("lines")})
    cutoff = F.lit("1998-01-01").cast("date")
    early = F.coalesce(F.col("received") < cutoff, F.lit(False))
    rollup.create(lines.where(early))
    rollup.add(lines.where(~early))
    return rollup.read(spark)


def _price_asof(spark, d):
    """Every item day with the price on record: the highest of the latest earlier week that has one."""
    days = retail.product_days(spark, d)
    week = F.floor((F.unix_date("date") + 3) / 7)
    weekly = days.where("unit_price is not null").groupBy("item_id", week.alias("week")).agg(F.max("unit_price").alias("recorded_price"))
    asked = days.select("item_id", "date", "sales", week.alias("week"))
    return tidy(asof.asof_join(asked, weekly, ["item_id"], "week", ["recorded_price"]).drop("week"))


MODELS = list(SEASONS)[:2]

QUERIES: dict[str, Query] = {
    # sources and sinks
    "csv_round_trip": lambda s, d: _round_trip(s, d, "csv"),
    "parquet_round_trip": lambda s, d: _round_trip(s, d, "parquet"),
    "feature_dictionary": lambda s, d: tidy(_described(s, d)),
    # projection, schema and reshape
    "snake_columns": lambda s, d: cleaning.snake_columns(retail.raw_calendar(s, d)),
    "ensure_price_column": _ensure_price,
    "unpivot_daily_sales": _unpivot,
    "unpivot_store_sales": lambda s, d: cleaning.unpivot_daily_sales(store_wide(s, d)),
    "history_feature_long": lambda s, d: tidy(reports.history_feature_long(filtered_features(s, d), HISTORY_FEATURE)),
    # filters
    "scope_store": lambda s, d: tidy(cleaning.scope_store(retail.sales_fact(s, d, STORE), STORE)),
    "price_demand_points": lambda s, d: tidy(exploration.price_demand_points(fact(s, d))),
    "filter_panel": lambda s, d: tidy(reports.filter_panel(panel(s, d), DATE_FROM, DATE_TO, CATEGORY)),
    "model_ready": lambda s, d: tidy(ready_features(s, d).select("date", "cat_id", "units_sold", "lag_28", "rolling_mean_28", "has_complete_sales_history")),
    "train_test_split": _train_test_split,
    "duplicate_keys": lambda s, d: cleaning.duplicate_keys(retail.lines(s, d), ["store_id", "item_id", "date"]),
    # joins
    "join_calendar": _join_calendar,
    "join_prices": _join_prices,
    "selected_product_sales": lambda s, d: tidy(product_sales(s, d).select(*contracts.PRODUCT_SALES_COLUMNS)),
    "join_event_calendar": lambda s, d: features.join_event_calendar(unpriced(s, d).select("date", "cat_id", "is_event"), events(s, d)),
    "event_calendar": events,
    # cleaning and validation
    "missing_summary": lambda s, d: cleaning.missing_summary(retail.calendar(s, d)),
    "missing_summary_sales": lambda s, d: cleaning.missing_summary(fact(s, d)),
    "missing_summary_prices": lambda s, d: cleaning.missing_summary(retail.prices(s, d)),
    "duplicate_rows": _duplicate_rows,
    "duplicate_rows_wide": lambda s, d: cleaning.duplicate_rows(io.materialize(retail.raw_wide(s, d), "wide")),
    "missing_summary_wide": lambda s, d: cleaning.missing_summary(retail.raw_wide(s, d)),
    "duplicate_rows_calendar": lambda s, d: cleaning.duplicate_rows(retail.calendar(s, d)),
    "duplicate_rows_prices": lambda s, d: cleaning.duplicate_rows(retail.prices(s, d)),
    "sales_profile": lambda s, d: cleaning.sales_profile(fact(s, d)),
    "price_missing_summary": lambda s, d: tidy(cleaning.price_missing_summary(fact(s, d))),
    "price_missing_by_month": lambda s, d: tidy(cleaning.price_missing_by_month(fact(s, d))),
    "sales_complete": lambda s, d: tidy(fact(s, d)),
    "daily_category_sales": lambda s, d: tidy(cleaning.daily_category_sales(fact(s, d), one_row_per_item=True)),
    "date_range": lambda s, d: features.date_range(unpriced(s, d)),
    "feature_validation": lambda s, d: features.feature_validation(ready_features(s, d), "cat_id", "units_sold"),
    "product_feature_validation": lambda s, d: features.feature_validation(features.model_ready(product_features(s, d)), "item_id", "sales", "sell_price"),
    "leakage_check": lambda s, d: tidy(features.leakage_check(ready_features(s, d), "units_sold")),
    "product_leakage_check": lambda s, d: tidy(features.leakage_check(features.model_ready(product_features(s, d)), "sales")),
    "feature_summary": _feature_summary,
    "series_validation": lambda s, d: evaluation.series_validation(stored_features(s, d)),
    "series_agreement": _series_agreement,
    "split_validation": _split_validation,
    "forecast_validation": lambda s, d: evaluation.forecast_validation(naive_errors(s, d), evaluation.train_test_split(stored_units(s, d), HORIZON)[1], len(SEASONS)),
    "forecast_metadata": _metadata,
    "active_items_rollup": _active_items,
    "price_quartiles": lambda s, d: tidy(_price_quartiles(s, d)),
    "selected_medians": lambda s, d: tidy(_selected_medians(s, d)),
    "bucketed_prices": lambda s, d: tidy(_bucketed_prices(s, d)),
    "bucketed_selection": lambda s, d: tidy(_bucketed_selection(s, d)),
    "filter_panel_pruned": lambda s, d: tidy(_pruned_panel(s, d)),
    "holdout_pruned": lambda s, d: tidy(_pruned_holdout(s, d)),
    "rollup_kept_up": _kept_up_rollup,
    "price_asof": _price_asof,
    # exploration
    "daily_total": lambda s, d: tidy(exploration.daily_total(unpriced(s, d))),
    "daily_total_ma30": lambda s, d: tidy(exploration.daily_total_ma30(unpriced(s, d))),
    "monthly_seasonality": lambda s, d: exploration.monthly_seasonality(unpriced(s, d)),
    "category_summary": lambda s, d: tidy(exploration.category_summary(unpriced(s, d))),
    "weekday_totals": lambda s, d: exploration.weekday_totals(unpriced(s, d)),
    "event_effect": lambda s, d: tidy(exploration.event_effect(unpriced(s, d))),
    "snap_effect": lambda s, d: tidy(exploration.snap_effect(unpriced(s, d))),
    "price_demand_curve": lambda s, d: tidy(exploration.price_demand_curve(fact(s, d), PRICE_WIDTH)),
    "price_demand_fit": lambda s, d: tidy(exploration.price_demand_fit(fact(s, d))),
    "product_totals": lambda s, d: exploration.top_k_strict(exploration.product_totals(retail.item_totals(s, d)), "total_sales", 20, "item_id"),
    "product_summary": lambda s, d: tidy(products(s, d)),
    "top_products": lambda s, d: exploration.top_products(retail.item_totals(s, d)),
    "top_products_strict": lambda s, d: exploration.top_k_strict(exploration.product_totals(retail.item_totals(s, d)), "total_sales", 10, "item_id"),
    "select_top_products": lambda s, d: exploration.select_top_products(retail.item_totals(s, d), SELECTED),
    "top_products_per_category": lambda s, d: exploration.top_products_per_category(retail.item_totals(s, d)),
    # features
    "calendar_features": lambda s, d: tidy(features.calendar_features(retail.calendar(s, d).select("date"))),
    "sales_history_features": lambda s, d: tidy(features.sales_history_features(retail.category_units(s, d), ["cat_id"], "units_sold")),
    "price_features": lambda s, d: tidy(features.price_features(panel(s, d).select("date", "cat_id", "average_price"), ["cat_id"], "average_price")),
    "category_features": lambda s, d: tidy(ready_features(s, d)),
    "product_features": lambda s, d: tidy(features.model_ready(product_features(s, d))),
    # models
    "seasonal_naive_forecast": _seasonal_naive,
    "ets_selection": _ets,
    "ets_forecast": lambda s, d: ets.ets_forecast(_ets(s, d), HORIZON),
    "ets_cells": lambda s, d: tidy(_ets_cells(s, d).drop("season", "observations")),
    "ets_cell_forecast": lambda s, d: tidy(ets.ets_forecast(ets_cells.best_cell(_ets_cells(s, d)), HORIZON)),
    "ets_states": lambda s, d: tidy(ets_cells.ets_states(_training_units(s, d), STATE_CELL)),
    "ets_rescored": _ets_rescored,
    "gbt_predictors": _predictors,
    "median_imputed_features": _imputed,
    "zero_variance_columns": _zero_variance,
    "gbt_model_frame": _encoded,
    "gbt_forecast": _gbt_forecast,
    "gbt_forecast_rows": lambda s, d: _gbt_forecast(s, d).select("date", "cat_id", "model", (F.col("predicted") >= 0).alias("not_negative")),
    "gbt_importance": _gbt_importance,
    "gbt_importance_totals": lambda s, d: _gbt_importance(s, d).agg(*[F.round(F.sum(c), 9).alias(c) for c in ("gain", "cover", "frequency")]),
    "top_importance": lambda s, d: reports.top_importance(_gbt_importance(s, d)),
    # evaluation
    "forecast_errors": lambda s, d: tidy(naive_errors(s, d)),
    "all_forecasts": lambda s, d: naive_errors(s, d).select("date", "cat_id", "model", "predicted", "actual"),
    "forecast_metrics": lambda s, d: evaluation.forecast_metrics(naive_errors(s, d)),
    "category_model_metrics": lambda s, d: evaluation.category_model_metrics(naive_errors(s, d)),
    "all_model_metrics": naive_metrics,
    "model_rankings": naive_rankings,
    "best_models": lambda s, d: evaluation.best_models(naive_rankings(s, d)),
    "forecasts_with_rank": lambda s, d: tidy(ranked_errors(s, d)),
    "category_residuals": lambda s, d: tidy(evaluation.category_residuals(ranked_errors(s, d))),
    "overall_metrics": lambda s, d: evaluation.overall_metrics(naive_metrics(s, d)),
    "forecasting_run_metrics": _all_models,
    "forecasting_run_rows": lambda s, d: _all_models(s, d).select(
        "cat_id", "model", "observations", ((F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae"))).alias("errors_agree")
    ),
    # reports
    "overview_kpis": lambda s, d: tidy(reports.overview_kpis(unpriced(s, d), retail.sold_products(s, d))),
    "category_mix": lambda s, d: reports.category_mix(unpriced(s, d)),
    "weekday_average": lambda s, d: tidy(reports.weekday_average(unpriced(s, d))),
    "month_average": lambda s, d: tidy(reports.month_average(unpriced(s, d))),
    "key_findings": lambda s, d: reports.key_findings(unpriced(s, d)),
    "demand_trend": lambda s, d: tidy(reports.demand_trend(unpriced(s, d), "revenue")),
    "monthly_category_trend": lambda s, d: reports.monthly_category_trend(unpriced(s, d)),
    "event_lift": lambda s, d: tidy(reports.event_lift(unpriced(s, d))),
    "intermittency_histogram": lambda s, d: exploration.intermittency_histogram(products(s, d)),
    "series_intermittency_histogram": _series_intermittency,
    "feature_linear_fit": lambda s, d: tidy(reports.feature_linear_fit(filtered_features(s, d), HISTORY_FEATURE)),
    "feature_group_counts": lambda s, d: reports.feature_group_counts(_described(s, d)),
    "feature_correlation": lambda s, d: reports.feature_correlation(filtered_features(s, d), HISTORY_FEATURE),
    "iso_weekday_average": lambda s, d: tidy(reports.iso_weekday_average(filtered_features(s, d))),
    "event_proximity_effect": lambda s, d: tidy(reports.event_proximity_effect(filtered_features(s, d))),
    "feature_missingness": lambda s, d: tidy(features.feature_missingness(ready_features(s, d), reports.MISSINGNESS_FEATURES)),
    "feature_table": lambda s, d: reports.feature_table(filtered_features(s, d)),
    "feature_kpis": _feature_kpis,
    "filter_choices": lambda s, d: reports.filter_choices(naive_errors(s, d), ("cat_id", "model")),
    "filter_forecasts": lambda s, d: tidy(reports.filter_forecasts(naive_errors(s, d), CATEGORY, MODELS)),
    "forecast_kpis": lambda s, d: reports.forecast_kpis(naive_metrics(s, d), naive_errors(s, d), HORIZON),
    "forecast_series": lambda s, d: reports.forecast_series(naive_errors(s, d), CATEGORY, MODELS),
    "actual_series": lambda s, d: reports.actual_series(naive_errors(s, d), CATEGORY, MODELS),
    "baseline_improvement": lambda s, d: reports.baseline_improvement(naive_metrics(s, d)),
    "metric_comparison": lambda s, d: reports.metric_comparison(naive_metrics(s, d), "rmse", CATEGORY),
    "model_recommendation": lambda s, d: reports.model_recommendation(naive_rankings(s, d)),
    "metrics_table": lambda s, d: reports.metrics_table(naive_metrics(s, d)),
    "residual_series": lambda s, d: tidy(reports.residual_series(naive_errors(s, d), CATEGORY, MODELS)),
    "residual_boxplot": lambda s, d: tidy(reports.residual_boxplot(naive_errors(s, d))),
    "residual_insight": lambda s, d: tidy(reports.residual_insight(naive_errors(s, d))),
    "forecast_table": lambda s, d: tidy(reports.forecast_table(ranked_errors(s, d))),
}
