"""What must not slip: sales in predictors, phantom rows, cut searches, other stores in a shuffle, files left behind."""

import datetime as dt
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelry.functions import smoothing
from panelry.operators import boosting, cleaning, evaluation, exploration, features
from panelry.plans import catalog
from panelry.sources import contracts, io, retail

SF_DIR = os.environ.get("PANELRY_SF_DIR", "/root/testdata/sf0.001")
START = dt.date(2020, 1, 1)
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def day(n):
    return START + dt.timedelta(n)


@needs_tables
def test_no_predictor_moves_with_the_sales_of_its_day(spark, tmp_path):
    """From sales lines to the model frame: other sales and prices on one holdout day change no predictor of that day."""
    for name in ("region", "nation", "supplier", "part"):
        os.symlink(f"{SF_DIR}/{name}.parquet", tmp_path / f"{name}.parquet")
    lines = retail.table(spark, SF_DIR, "lineitem")
    last = lines.agg(F.max(F.col("l_shipdate").cast("date"))).first()[0]
    sold = F.col("l_shipdate").cast("date") == F.lit(last - dt.timedelta(9))
    changed = lines.withColumns({
        "l_quantity": F.when(sold, F.col("l_quantity") * 3).otherwise(F.col("l_quantity")),
        "l_extendedprice": F.when(sold, F.col("l_extendedprice") * 30).otherwise(F.col("l_extendedprice")),
    })
    changed.write.parquet(str(tmp_path / "lineitem.parquet"))
    frames = []
    for tables in (SF_DIR, str(tmp_path)):
        ready = catalog.ready_features(spark, tables).where(F.col("date") == F.lit(last - dt.timedelta(9)))
        names = boosting.gbt_predictors(ready)
        frames.append((sorted(map(str, ready.select(*names).collect())), sorted(map(str, ready.select("cat_id", "units_sold").collect()))))
    assert frames[0][0] == frames[1][0] and frames[0][1] != frames[1][1]
    assert "average_price" in names


def test_recorded_price_is_carried_from_earlier_weeks(spark):
    panel = spark.createDataFrame([(day(i), "c", 202001 + i // 7) for i in range(28)], "date date, cat_id string, wm_yr_wk int")
    changes = spark.createDataFrame([("c", 202001, 1000, 1), ("c", 202003, 600, 1)], "cat_id string, wm_yr_wk int, _rise long, _new long")
    got = [r.average_price for r in retail.with_recorded_price(panel, changes).orderBy("date").collect()]
    assert got == [None] * 7 + [10.0] * 14 + [8.0] * 7


def test_densify_keeps_repeated_days_and_adds_no_phantoms(spark):
    df = spark.createDataFrame([(day(i), "a", 1.0) for i in (1, 3, 3, 5)], "date date, k string, v double")
    rows = features.densify(df, ["k"], F.lit(day(1)), F.lit(day(6)), zero=["v"]).collect()
    assert sorted((r.date - START).days for r in rows) == [1, 2, 3, 3, 4, 5, 6]
    assert sum(r.v for r in rows) == 4.0


def test_a_series_without_forecasts_shows(spark):
    test = spark.createDataFrame([(day(i), c, 1.0) for i in range(4) for c in "ab"], "date date, cat_id string, units_sold double")
    errors = test.where("cat_id = 'a'").select("date", "cat_id", F.col("units_sold").alias("actual"), F.lit(1.0).alias("predicted"))
    row = evaluation.forecast_validation(errors, test, 1).first()
    assert (row.rows, row.expected_rows) == (4, 8)


def test_the_search_reaches_its_limits():
    walk = np.cumsum(np.random.default_rng(0).normal(size=400))
    form, score, alpha, *_ = smoothing.fit_series(walk, 7)
    assert form == "ANN" and alpha > 0.95
    twice = np.cumsum(np.cumsum(np.random.default_rng(1).normal(size=400))) + 500
    best = smoothing.fit_series(twice, 7)
    assert best[2] > 0.95
    for y, found in ((walk, score), (twice, best[1])):
        cells = [(a, s, 0.0, 1.0, lift, tilt) for a in np.linspace(0.05, 0.9999, 25) for s in (1e-4, 0.1, 0.5, 0.9999) for lift in (-1, 0, 1) for tilt in (-1, 0, 1)]
        for trend in "NA":
            dense = smoothing.run_candidates(y, [("A", trend, "N")] * len(cells), np.array(cells), 7, False)[0]
            assert dense.min() > found - 0.1


def test_boosting_takes_a_table_without_any_price(spark):
    rows = [(day(i), c, float(i % 7 + 1), i % 7) for i in range(90) for c in "ab"]
    df = contracts.ensure_price_column(spark.createDataFrame(rows, "date date, cat_id string, units_sold double, weekday_number int"))
    train, test = evaluation.train_test_split(df, 28)
    names = boosting.gbt_predictors(df)
    assert "average_price" in names
    model = boosting.fit_gbt(train, names, trees=3)
    assert boosting.gbt_forecast(model, test, names).where("predicted is not null").count() == 56
    assert {r.feature for r in boosting.gbt_importance(model, train, names).collect()} == {"weekday_number"}


def test_imputation_uses_the_median_the_model_uses(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, None), ("b", None, None)], "cat_id string, average_price double, lag_28 double")
    assert boosting.training_medians(df, ["cat_id", "average_price", "lag_28"]) == {"average_price": 1.5}
    got = boosting.median_imputed_features(df, ["cat_id", "average_price", "lag_28"])
    assert got.columns == ["cat_id", "average_price"] and sorted(r.average_price for r in got.collect()) == [1.0, 1.5, 2.0]


def test_names_follow_the_cleaning_rules(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["2016 units", "% off", "HTTPCode", "item #", "snap_CA"])
    assert cleaning.snake_columns(df).columns == ["x2016_units", "percent_off", "http_code", "item_number", "snap_ca"]


def test_intermittency_bins_spread(spark):
    shares = [0.0, 2.4, 2.5, 49.9, 50.0, 99.9, 100.0]
    df = spark.createDataFrame([(s,) for s in shares], "zero_sales_pct double")
    got = {r.bin: (r.from_pct, r.to_pct, r.products) for r in exploration.intermittency_histogram(df).collect()}
    assert got == {0: (0.0, 2.5, 2), 1: (2.5, 5.0, 1), 19: (47.5, 50.0, 1), 20: (50.0, 52.5, 1), 39: (97.5, 100.0, 2)}


def test_backward_fill_finds_the_next_event(spark):
    df = spark.createDataFrame([(day(i), int(i in (2, 6))) for i in range(9)], "date date, is_event int")
    got = [r.days_until_event for r in features.event_calendar(df).orderBy("date").collect()]
    assert got == [2, 1, 0, 3, 2, 1, 0, None, None]


@needs_tables
def test_one_store_is_scoped_before_the_roll_up(spark):
    text = catalog.QUERIES["scope_store"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    lines = text.splitlines()
    rolled = next(i for i, line in enumerate(lines) if "Aggregate" in line and "store_no" in line)
    assert any(catalog.STORE in line for line in lines[rolled:]) and re.search("LeftSemi", "\n".join(lines[rolled:]))


def test_nothing_stays_in_the_shared_folder(spark):
    folder = io.shared_folder(spark).removeprefix("file:")
    io.materialize(spark.range(5).toDF("id"), "left")
    assert any(name.startswith("panelry-left") for name in os.listdir(folder))
    mine = [os.path.basename(path) for path in io._WRITTEN]
    io.clean_up()
    catalog._FITTED.clear()
    assert mine and not set(mine) & set(os.listdir(folder)) and not io._WRITTEN
