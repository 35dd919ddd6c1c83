"""Column expressions: weighted means, guarded ratios, null-safe membership, labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Weekday names from Monday, as ISO weekday 1 to 7.
ISO_WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKEND = ["Saturday", "Sunday"]


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def is_in(value: str | Column, members: Iterable) -> Column:
    """Membership that is false, not null, for a null value."""
    return F.coalesce(col(value).isin(list(members)), F.lit(False))


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Weighted mean over the rows whose value is not null."""
    value, weight = col(value), col(weight)
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def total(value: str | Column) -> Column:
    """Sum that is 0, not null, when there is nothing to add."""
    return F.coalesce(F.sum(col(value)), F.lit(0.0))


def percent_where(condition: Column) -> Column:
    """Percentage of rows for which the condition holds."""
    return F.avg(condition.cast("double")) * 100


def missing(name: str, dtype: str) -> Column:
    """Null test that counts NaN as missing in floating columns."""
    column = F.col(f"`{name}`")
    return column.isNull() | F.isnan(column) if dtype in ("double", "float") else column.isNull()


def percent_label(value: str | Column, digits: int = 2) -> Column:
    """``"7.49%"``, ``"8.4%"``, ``"8%"``: rounded, without trailing zeros."""
    number = F.format_string(f"%.{digits}f", F.round(col(value), digits))
    label = F.concat(F.regexp_replace(number, r"\.?0+$", ""), F.lit("%"))
    return F.when(col(value).isNotNull(), label)


def iso_weekday(date: str | Column) -> Column:
    """Monday = 1 … Sunday = 7."""
    return (F.weekday(col(date)) + 1).cast("int")


def iso_week_key(date: str | Column) -> Column:
    """ISO year and week as one integer, e.g. 201607."""
    date = col(date)
    return (F.extract(F.lit("YEAROFWEEK"), date) * 100 + F.weekofyear(date)).cast("int")


def weekday_name(number: str | Column) -> Column:
    """Name of an ISO weekday number."""
    return F.element_at(F.array(*[F.lit(name) for name in ISO_WEEKDAYS]), col(number))


def exact(name: str) -> Column:
    """A number as decimal, so that its sum does not depend on the order of the rows."""
    return F.col(name).cast("decimal(28,10)")
