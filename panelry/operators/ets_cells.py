"""Exponential smoothing as a table: series × form × parameter cell, each row smoothed by an ordered fold over its values.

Where ``ets`` searches parameters, this scores given ones, with built-in functions only. The same fold
scores a searched winner again (``rescored``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelry.functions.smoothing import STARTING_CYCLES
from panelry.operators.ets import series_rows

# Cells of the registered queries, as form, alpha, beta, gamma, phi.
CELLS = [
    (form, alpha, round(alpha * slope, 6) if form[1] == "A" else 0.0, 0.1 if form[-1] != "N" else 0.0, 0.9 if "Ad" in form else 1.0)
    for form in ("ANN", "AAN", "AAdN", "ANA", "AAA", "AAdA", "MNN", "MNM", "MAM", "MAdM")
    for alpha, slope in ((0.1, 0.1), (0.4, 0.2))
]
CELL_TYPE = "array<struct<form string, alpha double, beta double, gamma double, phi double>>"
TINY = 2.2250738585072014e-308  # the least sum of squares of a series that fits exactly
STATE = "struct<level double, trend double, season array<double>, squared double, relative double, logs double>"


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, y: total + y) / F.size(values)


def _flags(form: Column) -> dict[str, Column]:
    """What the letters of a form say."""
    return {
        "relative": form.startswith("M"), "times": form.endswith("M"), "seasonal": ~form.endswith("N"),
        "trended": F.substring(form, 2, 1) == "A", "damped": form.contains("Ad"),
    }


def with_start(rows: DataFrame, period: int) -> DataFrame:
    """The starting level, spread, rise and cycle of each series, from its first ``STARTING_CYCLES`` periods."""
    head = rows.withColumn("_head", F.slice("values", 1, period * STARTING_CYCLES)).withColumn("_n", F.size("_head"))
    overall = head.withColumn("_overall", _mean(F.col("_head")))
    early, late = _mean(F.slice("_head", 1, period)), _mean(F.slice("_head", F.greatest(F.col("_n") - period + 1, F.lit(1)), F.lit(period)))
    spread = F.sqrt(_mean(F.transform("_head", lambda y: (y - F.col("_overall")) * (y - F.col("_overall")))))
    of_day = lambda j: F.filter("_head", lambda y, i: i % period == j)
    cycle = F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda j: F.when(F.col("_n") > j, _mean(of_day(j))).otherwise(F.col("_overall")))
    return overall.withColumns({
        "_spread": spread, "_rise": (late - early) / F.greatest(F.col("_n") - period, F.lit(1)), "_cycle": cycle,
    })


def _first_state(flags: dict[str, Column], lift: Column, tilt: Column) -> Column:
    effect = lambda c: F.when(~flags["seasonal"], F.when(flags["times"], 1.0).otherwise(0.0)).when(
        flags["times"], F.try_divide(c, F.col("_overall"))).otherwise(c - F.col("_overall"))
    zero = F.lit(0.0)
    return F.struct(
        (F.col("_overall") + lift * F.col("_spread")).alias("level"),
        F.when(flags["trended"], tilt * F.col("_rise")).otherwise(0.0).alias("trend"),
        F.transform("_cycle", effect).alias("season"), zero.alias("squared"), zero.alias("relative"), zero.alias("logs"),
    ).cast(STATE)


def _step(state: Column, y: Column, place: Column, period: int) -> dict[str, Column]:
    """The parts of one day: base, effect, what is expected, the gap, and the next level, trend and season."""
    times = F.col("form").endswith("M")
    slope = F.col("phi") * state["trend"]
    base = state["level"] + slope
    effect = F.get(state["season"], place)
    expected = F.when(times, base * effect).otherwise(base + effect)
    gap = y - expected
    pull = F.when(times, F.try_divide(gap, effect)).otherwise(gap)
    moved = effect + F.col("gamma") * F.when(times, F.try_divide(gap, base)).otherwise(gap)
    return {
        "expected": expected, "gap": gap, "level": base + F.col("alpha") * pull, "trend": slope + F.col("beta") * pull,
        "season": F.transform(state["season"], lambda s, j: F.when(j == place, moved).otherwise(s)),
    }


def _folded(period: int) -> Column:
    """The state after all values, in their order."""

    def advance(state: Column, day: Column) -> Column:
        now = _step(state, day["y"], day["j"], period)
        ratio = F.try_divide(now["gap"], now["expected"])
        return F.struct(
            now["level"].alias("level"), now["trend"].alias("trend"), now["season"].alias("season"),
            (state["squared"] + now["gap"] * now["gap"]).alias("squared"), (state["relative"] + ratio * ratio).alias("relative"),
            (state["logs"] + F.log(F.abs(now["expected"]))).alias("logs"),
        ).cast(STATE)

    days = F.transform("values", lambda y, i: F.struct(y.alias("y"), (i % period).alias("j")))
    return F.aggregate(days, F.col("_first"), advance)


def scored_cells(rows: DataFrame, period: int = 7) -> DataFrame:
    """``rows`` (values, observations, form, alpha, beta, gamma, phi, lift, tilt and keys) with ``aicc`` and the last ``state``.

    Rows whose form does not fit the series have a null ``aicc``: a multiplicative one with a value of zero or less,
    a seasonal one with fewer than two periods, any with too few values for its parameters, and any whose
    recursion leaves the numbers.
    """
    flags = _flags(F.col("form"))
    started = with_start(rows, period).withColumn("_first", _first_state(flags, F.col("lift"), F.col("tilt")))
    done = started.withColumn("state", _folded(period))
    n, one = F.col("observations"), lambda flag: flag.cast("int")
    count = (
        1 + 2 * one(flags["trended"]) + one(flags["seasonal"]) * period + one(flags["damped"]) + 2
    )
    additive = n * F.log(F.greatest(F.col("state.squared"), F.lit(TINY)))
    relative = n * F.log(F.greatest(F.col("state.relative"), F.lit(TINY))) + 2 * F.col("state.logs")
    spare = n - count - 1
    fits = (spare > 0) & (~(flags["relative"] | flags["times"]) | (F.array_min("values") > 0)) & (~flags["seasonal"] | (n >= 2 * period))
    value = F.when(flags["relative"], relative).otherwise(additive) + 2 * count + F.try_divide(2 * count * (count + 1), spare)
    helpers = [c for c in done.columns if c.startswith("_")]
    return done.withColumn("aicc", F.when(fits, F.nanvl(value, F.lit(None)))).drop(*helpers)


def cells_of(train: DataFrame, key: str, target: str, cells: Sequence[tuple] = tuple(CELLS)) -> DataFrame:
    """Every series beside every cell: one row a series is gathered, then each becomes one row a cell."""
    every = F.array(*[F.struct(*[F.lit(v) for v in cell]) for cell in cells]).cast(CELL_TYPE)
    return series_rows(train, key, target).select(key, "last_date", "observations", "values", F.posexplode(every).alias("cell", "_c")).select(
        key, "last_date", "observations", "values", F.col("cell").cast("int").alias("cell"), "_c.*",
        F.lit(0.0).alias("lift"), F.when(F.substring("_c.form", 2, 1) == "A", 1.0).otherwise(0.0).alias("tilt"),
    )


def ets_cells(train: DataFrame, key: str = "cat_id", target: str = "units_sold", period: int = 7, cells: Sequence[tuple] = tuple(CELLS)) -> DataFrame:
    """AICc, rank within the series, and final level and trend of every cell that fits, of every series.

    Equal scores rank by cell number. A series without values has no rows.
    """
    scored = scored_cells(cells_of(train, key, target, cells), period).where("aicc is not null")
    best = Window.partitionBy(key).orderBy("aicc", "cell")
    return scored.select(
        key, "last_date", "cell", "form", "alpha", "beta", "gamma", "phi", "aicc", F.row_number().over(best).alias("rank"),
        F.col("state.level").alias("level"), F.col("state.trend").alias("trend"), F.col("state.season").alias("season"), "observations",
    )


def best_cell(cells: DataFrame, period: int = 7) -> DataFrame:
    """The first cell of each series in the shape of ``ets.ets_selection``: the season begins with the first forecast day."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda j: F.get("season", (F.col("observations") + j) % period))
    return cells.where("rank = 1").withColumn("season", F.when(~F.col("form").endswith("N"), turned))


def ets_states(train: DataFrame, cell: tuple, key: str = "cat_id", target: str = "units_sold", period: int = 7) -> DataFrame:
    """What was expected of every day of every series under one cell, and level, trend and season effect after the day.

    The fold keeps the trail of its states, so a series must be short enough for one row, as everywhere in this module.
    """
    rows = with_start(cells_of(train, key, target, [cell]), period)
    rows = rows.withColumn("_first", _first_state(_flags(F.col("form")), F.col("lift"), F.col("tilt")))
    trail_type = "array<struct<expected double, level double, trend double, effect double>>"
    start = F.struct(F.col("_first").alias("state"), F.array().cast(trail_type).alias("trail"))

    def advance(seen: Column, day: Column) -> Column:
        state = seen["state"]
        now = _step(state, day["y"], day["j"], period)
        after = F.struct(
            now["level"].alias("level"), now["trend"].alias("trend"), now["season"].alias("season"),
            state["squared"].alias("squared"), state["relative"].alias("relative"), state["logs"].alias("logs"),
        ).cast(STATE)
        step = F.struct(now["expected"].alias("expected"), now["level"].alias("level"), now["trend"].alias("trend"), F.get(now["season"], day["j"]).alias("effect"))
        return F.struct(after.alias("state"), F.array_append(seen["trail"], step).cast(trail_type).alias("trail"))

    days = F.transform("values", lambda y, i: F.struct(y.alias("y"), (i % period).alias("j")))
    folded = rows.select(key, F.aggregate(days, start, advance, lambda seen: seen["trail"]).alias("trail"))
    return folded.select(key, F.posexplode("trail").alias("day_number", "s")).select(key, "day_number", "s.*")


def rescored(train: DataFrame, selection: DataFrame, key: str = "cat_id", target: str = "units_sold", period: int = 7) -> DataFrame:
    """The AICc of each series' searched winner (``ets.ets_selection``) and the one the fold gives for the same parameters."""
    found = selection.select(key, "form", "alpha", "beta", "gamma", "phi", "lift", "tilt", F.col("aicc").alias("searched_aicc"))
    rows = series_rows(train, key, target).join(found, key)
    return scored_cells(rows, period).select(key, "form", "searched_aicc", "aicc")
