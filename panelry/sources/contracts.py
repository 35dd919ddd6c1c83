"""Schemas of the raw inputs and column contracts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

# Raw input schemas and the column lists each stage needs.
CALENDAR_SCHEMA = (
    "date date, wm_yr_wk int, weekday string, wday int, month int, year int, d string, "
    "event_name_1 string, event_type_1 string, event_name_2 string, event_type_2 string, "
    "snap_CA int, snap_TX int, snap_WI int"
)
PRICE_SCHEMA = "store_id string, item_id string, wm_yr_wk int, sell_price double"
SALES_KEYS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
PRODUCT_SALES_COLUMNS = [
    "date", "item_id", "dept_id", "cat_id", "sales", "sell_price", "is_event", "is_weekend", "snap_ca",
]
MODEL_INPUT_COLUMNS = [
    "date", "cat_id", "units_sold", "lag_28", "calendar_month", "calendar_week", "calendar_quarter",
    "day_of_month", "day_of_year", "weekday_number", "month_sin", "month_cos", "weekday_sin",
    "weekday_cos", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end",
    "is_weekend", "is_event", "within_3_days_of_event", "within_7_days_of_event", "snap_ca",
]


class ContractError(ValueError):
    """A table does not have what an operator needs."""


def require_columns(df: DataFrame, required: Iterable[str], table: str = "table") -> DataFrame:
    """Return ``df`` unchanged, or raise naming every missing column."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ContractError(f"{table} lacks columns: {', '.join(missing)}")
    return df


def present(df: DataFrame, candidates: Iterable[str]) -> list[str]:
    """The candidate columns ``df`` has, in candidate order."""
    return [name for name in candidates if name in df.columns]


def ensure_price_column(
    df: DataFrame, name: str = "average_price", older_name: str = "average_selling_price"
) -> DataFrame:
    """Accept the older price column name, or add an all-null price."""
    if name in df.columns:
        return df
    if older_name in df.columns:
        return df.withColumnRenamed(older_name, name)
    return df.withColumn(name, F.lit(None).cast("double"))
