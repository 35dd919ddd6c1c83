"""Fills and moving windows in blocks against one plain window, and smoothing cells against a plain recursion."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from panelry.operators import ets_cells, exploration, features, scans
from panelry.plans import catalog

START = dt.date(2020, 1, 1)


def days(spark, n, gap=1, seed=1):
    rng = random.Random(seed)
    at = sorted(rng.sample(range(n * gap), n))
    return spark.createDataFrame([(START + dt.timedelta(i), float(rng.randrange(100)) if rng.random() < 0.15 else None) for i in at], "date date, v double")


@pytest.mark.parametrize("gap", [1, 40])
def test_fills_equal_a_plain_window(spark, gap):
    df = days(spark, 300, gap)
    order = Window.orderBy("date")
    want = df.withColumns({
        "a": F.last("v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "b": F.first("v", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    got = scans.with_fills(df, "date", F.col("v"), "a", "b", width=17)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("width,block_rows", [(1, 1), (13, 8), (10_000, 10_000)])
def test_moving_windows_equal_a_plain_window(spark, width, block_rows):
    df = days(spark, 200, 7).select("date", F.coalesce("v", F.lit(1.0)).alias("v"))
    frame = Window.orderBy("date").rowsBetween(-29, 0)
    made = lambda w: {"m": F.avg("v").over(w), "n": F.count(F.lit(1)).over(w), "top": F.max("v").over(w)}
    want = df.withColumns(made(frame))
    got = scans.with_moving(df, "date", 30, made, width, block_rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_row_numbers_of_timestamps_and_numbers(spark):
    df = spark.range(0, 90, 3).withColumn("t", F.timestamp_seconds(F.col("id") * 50))
    for order in ("id", "t"):
        got = scans.with_row_numbers(df, order, "k", width=20).orderBy("id").collect()
        assert [r.k for r in got] == list(range(30))


def test_empty_orders(spark):
    none = spark.createDataFrame([], "date date, v double")
    assert scans.with_fills(none, "date", F.col("v"), "a", "b").count() == 0
    assert exploration.with_moving_average(none.withColumnRenamed("v", "units")).count() == 0


def test_no_window_lacks_a_key(spark):
    df = spark.createDataFrame([(START + dt.timedelta(i), int(i % 9 == 0), 1.0) for i in range(50)], "date date, is_event int, units double")
    for got in (features.event_calendar(df), exploration.with_moving_average(df.select("date", "units"))):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "SinglePartition" not in plan.split("Window", 1)[1].split("Exchange", 1)[0]
        for line in plan.splitlines():
            if "Window [" in line:
                assert "_block" in line or "_in" in line


def plainly_smoothed(y, form, alpha, beta, gamma, phi, m=7):
    """Level, trend and season after all values, with one value at a time."""
    head = y[: 4 * m]
    overall = sum(head) / len(head)
    cycle = [sum(head[j::m]) / len(head[j::m]) for j in range(m)]
    level, trend = overall, (sum(head[-m:]) / m - sum(head[:m]) / m) / max(len(head) - m, 1) if form[1] == "A" else 0.0
    times, seasonal = form[-1] == "M", form[-1] != "N"
    season = [(c / overall if times else c - overall) if seasonal else (1.0 if times else 0.0) for c in cycle]
    squared = 0.0
    for t, v in enumerate(y):
        slope = phi * trend
        base, effect = level + slope, season[t % m]
        gap = v - (base * effect if times else base + effect)
        level, trend = base + alpha * (gap / effect if times else gap), slope + beta * gap / (effect if times else 1)
        season[t % m] = effect + gamma * (gap / base if times else gap)
        squared += gap * gap
    return level, trend, season, squared


def test_cells_follow_the_plain_recursion(spark):
    rng = random.Random(4)
    series = {c: [50 + 10 * (i % 7) + 0.2 * i + rng.random() for i in range(120)] for c in "ab"} | {"zero": [0.0] * 60, "short": [1.0, 2.0, 3.0]}
    rows = [(c, START + dt.timedelta(i), v) for c, ys in series.items() for i, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "cat_id string, date date, units_sold double")
    got = ets_cells.ets_cells(df).collect()
    for r in got:
        level, trend, season, _ = plainly_smoothed(series[r.cat_id], r.form, r.alpha, r.beta, r.gamma, r.phi)
        assert [r.level, r.trend, *r.season] == pytest.approx([level, trend, *season], abs=1e-6)
    assert {r.cat_id for r in got} == {"a", "b", "zero"}
    assert not any(r.form.startswith("M") or r.form.endswith("M") for r in got if r.cat_id == "zero")
    for c in "ab":
        ranked = sorted((r for r in got if r.cat_id == c), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and ranked[0].aicc == min(r.aicc for r in ranked)


def test_the_last_listed_state_is_the_folds(spark):
    rows = [("a", START + dt.timedelta(i), 20.0 + (i % 7) + i / 10) for i in range(60)]
    df = spark.createDataFrame(rows, "cat_id string, date date, units_sold double")
    trail = ets_cells.ets_states(df, catalog.STATE_CELL).orderBy("day_number").collect()
    level, trend, season, _ = plainly_smoothed([r[2] for r in rows], *catalog.STATE_CELL)
    assert len(trail) == 60 and [trail[-1].level, trail[-1].trend, trail[-1].effect] == pytest.approx([level, trend, season[59 % 7]])
