"""Checks that stop a run. Each reads at most one row of a check query to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelry.operators.cleaning import duplicate_keys
from panelry.operators.evaluation import forecast_validation, series_agreement, series_validation, split_validation
from panelry.sources.contracts import ContractError


def check_empty(df: DataFrame, message: str) -> None:
    """Raise when a check query returns a row."""
    if not df.isEmpty():
        raise ContractError(message)


def check_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Each key value occurs once."""
    check_empty(duplicate_keys(df, keys), f"duplicate rows for {', '.join(keys)}")


def check_series(panel: DataFrame, key: str = "cat_id", target: str = "units_sold") -> None:
    """No missing target, and all series have the same length and date range."""
    agreement = series_agreement(series_validation(panel, key, target))
    check_empty(agreement.where("missing_target > 0"), f"missing values in {target}")
    check_empty(agreement.where(~F.col("series_agree")), "series differ in length or date range")


def check_split(train: DataFrame, test: DataFrame, horizon: int, key: str = "cat_id") -> None:
    """The holdout fills the horizon in every series and starts after the training rows."""
    split = split_validation(train, test, horizon, key)
    check_empty(split.where(~F.col("fills_horizon")), f"a series does not have {horizon} holdout rows")
    check_empty(split.where("train_overlap"), "training and holdout rows overlap")


def check_forecasts(errors: DataFrame, test: DataFrame, models: int) -> None:
    """Every model has a forecast and an actual for every series and holdout day."""
    found = forecast_validation(errors, test, models)
    check_empty(found.where("rows <> expected_rows"), "unexpected number of forecast rows")
    check_empty(found.where("missing_actual > 0"), "forecasts without actual demand")
    check_empty(found.where("missing_predicted > 0"), "missing predictions")
