import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from panelry.operators import features, reports

START = dt.date(2020, 1, 1)


def day(n):
    return START + dt.timedelta(n)


@pytest.fixture(scope="module")
def panel(spark):
    series = {"a": [float((i * 7) % 11) for i in range(35)], "b": [0.0] * 20 + [float(i) for i in range(15)]}
    records = [(day(i), k, v, None) for k, values in series.items() for i, v in enumerate(values)]
    return series, spark.createDataFrame(records, "date date, cat_id string, units_sold double, average_price double")


def test_history_features_against_a_plain_loop(panel):
    series, df = panel
    got = {(r.cat_id, r.date): r for r in features.sales_history_features(df, ["cat_id"], "units_sold").collect()}
    for key, values in series.items():
        for i in range(len(values)):
            row = got[(key, day(i))]
            assert row.series_day_index == i + 1
            for n in (1, 7, 14, 28):
                assert row[f"lag_{n}"] == (values[i - n] if i >= n else None)
            for k in (7, 14, 28):
                past = values[max(0, i - k):i]
                mean = row[f"rolling_mean_{k}"]
                assert mean == (pytest.approx(statistics.mean(past)) if i + 1 >= k else None)
            past7, past28 = values[max(0, i - 7):i], values[max(0, i - 28):i]
            if i + 1 >= 7:
                assert row.rolling_sd_7 == pytest.approx(statistics.stdev(past7))
                assert (row.rolling_min_7, row.rolling_max_7) == (min(past7), max(past7))
            else:
                assert row.rolling_sd_7 is None and row.rolling_min_7 is None
            if i + 1 >= 28:
                assert row.zero_sales_rate_28 == pytest.approx(past28.count(0.0) / len(past28))


def test_model_ready_keeps_rows_from_day_29(panel):
    _, df = panel
    built = features.with_history_flag(features.sales_history_features(df, ["cat_id"], "units_sold"))
    assert features.model_ready(built).groupBy("cat_id").count().select("count").distinct().collect()[0][0] == 7


def test_no_feature_uses_the_current_day(panel):
    _, df = panel
    changed = df.withColumn("units_sold", F.when(F.col("date") == day(30), 999.0).otherwise(F.col("units_sold")))
    at = lambda d: (
        features.sales_history_features(d, ["cat_id"], "units_sold").where(F.col("date") == day(30)).drop("units_sold").collect()
    )
    assert sorted(map(tuple, at(df))) == sorted(map(tuple, at(changed)))


def test_price_features(spark):
    prices = [None, None, 0.0, 2.0, 3.0, 1.5] + [2.0] * 30
    df = spark.createDataFrame([(day(i), "a", p) for i, p in enumerate(prices)], "date date, k string, price double")
    got = [r for r in features.price_features(df, ["k"], "price").orderBy("date").collect()]
    assert [r.price_missing for r in got[:4]] == [1, 1, 0, 0]
    assert got[3].price_change_1 == 2.0 and got[3].price_pct_change_1 is None  # previous price is zero
    assert got[4].price_pct_change_1 == pytest.approx(0.5) and got[4].is_price_increase == 1
    assert got[5].is_price_decrease == 1 and got[2].is_price_increase == 0
    assert got[26].rolling_price_mean_28 is None
    known = [p for p in prices[:27] if p is not None]
    assert got[27].rolling_price_mean_28 == pytest.approx(statistics.mean(known))
    assert got[27].price_relative_to_28_day_mean == pytest.approx(2.0 / statistics.mean(known))


def test_event_calendar(spark):
    df = spark.createDataFrame(
        [(day(i), c, int(i in (9, 24))) for i in range(40) for c in "xy"], "date date, cat_id string, is_event int"
    )
    got = {r.date: r for r in features.event_calendar(df).collect()}
    assert len(got) == 40
    assert got[day(0)].days_since_event is None and got[day(0)].days_until_event == 9
    assert got[day(39)].days_until_event is None and got[day(39)].within_7_days_of_event == 0
    assert got[day(9)].days_since_event == 0 and got[day(9)].within_3_days_of_event == 1
    assert got[day(16)].days_since_event == 7 and got[day(16)].within_7_days_of_event == 1
    assert got[day(17)].within_7_days_of_event == 1  # seven days before the next one
    assert got[day(13)].within_3_days_of_event == 0


def test_densify_fills_every_gap(spark):
    df = spark.createDataFrame(
        [(day(3), "a", "A", 1.0, 9.0), (day(5), "a", "A", 2.0, None), (day(0), "b", "B", 4.0, 7.0)],
        "date date, k string, attr string, sales double, price double",
    )
    got = features.densify(df, ["k"], F.lit(day(0)), F.lit(day(6)), zero=["sales"], null=["price"])
    table = {(r.k, r.date): (r.attr, r.sales, r.price) for r in got.collect()}
    assert len(table) == 14
    assert table[("a", day(0))] == ("A", 0.0, None) and table[("a", day(3))] == ("A", 1.0, 9.0)
    assert table[("a", day(6))] == ("A", 0.0, None) and table[("b", day(6))] == ("B", 0.0, None)
    assert sum(v[1] for v in table.values()) == 7.0


def test_feature_dictionary_describes_built_features(panel, spark):
    _, df = panel
    flagged = df.withColumns({"is_event": F.lit(0), "snap_ca": F.lit(0)})
    built = features.category_features(flagged, features.event_calendar(flagged))
    names = [r.feature for r in features.feature_dictionary(spark).collect()]
    assert len(names) == 30 and set(names) <= set(built.columns)
    counts = {r["group"]: r.feature_count for r in reports.feature_group_counts(features.feature_dictionary(spark)).collect()}
    assert counts["Calendar"] == 10 and counts["External factor"] == 1


def test_missingness_takes_only_existing_columns(panel):
    _, df = panel
    got = {r.feature: r.missing_pct for r in features.feature_missingness(df, ["average_price", "units_sold", "absent"]).collect()}
    assert got == {"average_price": 100.0, "units_sold": 0.0}


def test_dense_values_equal_the_gathered_panel_and_gather_no_empty_day(spark):
    rows = [(day(3), "a", 2.0), (day(1), "a", 5.0), (day(6), "a", 0.0), (day(9), "b", 1.0), (day(0), "b", None),
            (day(4), "c", 7.0), (None, "c", 3.0), (None, "d", 1.0), (day(0), "e", 4.0), (None, "e", 6.0)]
    df = spark.createDataFrame(rows, "date date, k string, v double")
    lo, hi = F.lit(day(0)), F.lit(day(9))
    dense = features.densify(df, ["k"], lo, hi, zero=["v"])
    gathered = dense.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("date", "v")))["v"].alias("_values"))
    got = features.dense_values(df, ["k"], lo, hi, "v")
    assert {r.k: r._values for r in got.collect()} == {r.k: r._values for r in gathered.collect()}
    assert got.where("k = 'a'").first()._values == [0.0, 5.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
