"""The batch stages from raw CSV files to stored outputs."""

import datetime as dt
import random

import pytest

from panelry.plans import pipeline
from panelry.sources.io import read_table

DAYS, STORES, ITEMS = 120, ["S_1", "S_2"], [("F_1", "F", "FOODS"), ("F_2", "F", "FOODS"), ("H_1", "H", "HOBBIES")]
START = dt.date(2015, 1, 3)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    raw, out = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("out")
    rng = random.Random(7)
    names = ["Saturday", "Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
    lines = ["date,wm_yr_wk,weekday,wday,month,year,d,event_name_1,event_type_1,event_name_2,event_type_2,snap_CA,snap_TX,snap_WI"]
    for i in range(DAYS):
        day = START + dt.timedelta(i)
        event = "Feast,National" if i % 45 == 20 else "NA,NA"
        lines.append(
            f"{day},{11500 + i // 7},{names[i % 7]},{i % 7 + 1},{day.month},{day.year},d_{i + 1},{event},NA,NA,{i % 2},0,1"
        )
    (raw / "calendar.csv").write_text("\n".join(lines) + "\n")
    lines = ["id,item_id,dept_id,cat_id,store_id,state_id," + ",".join(f"d_{i + 1}" for i in range(DAYS))]
    sales = {}
    for store in STORES:
        for item, dept, cat in ITEMS:
            values = [rng.choice([0, 1, 2, 5]) + (i % 7) for i in range(DAYS)]
            sales[store, item] = values
            lines.append(f"{item}_{store},{item},{dept},{cat},{store},CA," + ",".join(map(str, values)))
    (raw / "sales_train_evaluation.csv").write_text("\n".join(lines) + "\n")
    lines = ["store_id,item_id,wm_yr_wk,sell_price"]
    for store in STORES:
        for item, _, _ in ITEMS:
            for week in range(DAYS // 7 + 1):
                if not (item == "H_1" and week < 3):
                    lines.append(f"{store},{item},{11500 + week},{1 + week / 10 + len(item)}")
    (raw / "sell_prices.csv").write_text("\n".join(lines) + "\n")

    pipeline.clean(spark, str(raw), str(out), "S_1")
    pipeline.explore(spark, str(out), selected=2)
    pipeline.build_features(spark, str(out))
    pipeline.forecast(spark, str(out), "S_1", trees=3, spread=2)
    return sales, str(out)


def test_fact_is_dense_and_scoped(spark, stored):
    sales, out = stored
    fact = read_table(spark, f"{out}/sales_complete.parquet")
    assert fact.count() == len(ITEMS) * DAYS
    assert fact.where("store_id <> 'S_1'").isEmpty()
    assert fact.where("sell_price is null").count() == 21  # three weeks of one item
    got = fact.where("item_id = 'H_1'").orderBy("date").collect()
    assert [r.sales for r in got] == [float(v) for v in sales["S_1", "H_1"]]


def test_summary_and_features(spark, stored):
    sales, out = stored
    products = read_table(spark, f"{out}/product_summary.csv").collect()
    assert {r.item_id: r.total_sales for r in products} == {i: float(sum(sales["S_1", i])) for i, _, _ in ITEMS}
    summary = {r.dataset: r for r in read_table(spark, f"{out}/feature_summary.csv").collect()}
    assert summary["Category-level"].rows == 2 * (DAYS - 28) and summary["Category-level"].feature_count == 61
    assert summary["Product-level"].rows == 2 * (DAYS - 28) and summary["Product-level"].feature_count == 51
    assert read_table(spark, f"{out}/feature_dictionary.csv").count() == 30


def test_forecast_outputs(spark, stored):
    _, out = stored
    forecasts = read_table(spark, f"{out}/category_forecasts.csv")
    assert forecasts.count() == 2 * 28 * 3
    assert forecasts.columns == [
        "date", "cat_id", "model", "predicted", "actual", "residual", "absolute_error", "squared_error",
        "absolute_percentage_error", "model_rank", "is_best_model",
    ]
    metrics = read_table(spark, f"{out}/category_model_metrics.csv")
    assert metrics.count() == 9 and metrics.where("cat_id = 'ALL'").count() == 3
    assert read_table(spark, f"{out}/category_model_rankings.csv").where("is_best_model").count() == 2
    meta = read_table(spark, f"{out}/forecasting_metadata.csv").first()
    assert (meta.forecast_horizon_days, meta.categories, meta.models_evaluated) == (28, 2, 3)
    assert meta.training_start_date == START + dt.timedelta(28)
    assert meta.testing_end_date == START + dt.timedelta(DAYS - 1)
    assert read_table(spark, f"{out}/feature_importance.csv").count() > 0
