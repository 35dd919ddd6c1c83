import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelry.functions.expressions import percent_label
from panelry.operators import checks, cleaning, exploration, reports
from panelry.sources import contracts, io


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_snake_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["snap_CA", "itemID", "Unit Price", "unit.price"])
    assert cleaning.snake_columns(df).columns == ["snap_ca", "item_id", "unit_price", "unit_price_2"]


def test_unpivot_keeps_labels_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, None, 3.0)], "item_id string, d_1 double, d_2 double, d_10 double")
    got = rows(cleaning.unpivot_daily_sales(df))
    assert got == [("a", "d_1", 1.0), ("a", "d_2", None), ("a", "d_10", 3.0)]


def test_flags_and_revenue(spark):
    df = spark.createDataFrame(
        [("Saturday", None, None, 2.0, 1.5), ("Monday", None, "Easter", 1.0, None), (None, "Xmas", None, 0.0, 2.0)],
        "weekday string, event_name_1 string, event_name_2 string, sales double, sell_price double",
    )
    got = rows(cleaning.add_row_flags(df).select("is_event", "is_weekend", "revenue"))
    assert got == [(0, 1, 3.0), (1, 0, None), (1, 0, 0.0)]


def test_weighted_price_uses_floor_weight_and_skips_nulls(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 10.0, 0.0), ("b", 3.0, 2.0, 6.0), ("c", 5.0, None, None)],
        "item_id string, sales double, sell_price double, revenue double",
    ).withColumn("k", F.lit(1))
    for one_row in (True, False):
        got = cleaning.daily_category_sales(df, ["k"], one_row_per_item=one_row).first()
        assert got.average_price == pytest.approx((10 * 1 + 2 * 3) / 4)
        assert (got.units_sold, got.revenue, got.active_items) == (8.0, 6.0, 2)


def test_all_null_revenue_is_zero_and_price_stays_null(spark):
    df = spark.createDataFrame([("a", 1.0, None, None)], "item_id string, sales double, sell_price double, revenue double")
    got = cleaning.daily_category_sales(df.withColumn("k", F.lit(1)), ["k"]).first()
    assert got.revenue == 0.0 and got.average_price is None


def test_missing_summary_counts_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (None, 2.0), (None, 3.0)], "a int, b double")
    assert rows(cleaning.missing_summary(df)) == [("a", 2, 66.67), ("b", 1, 33.33)]


def test_missing_summary_of_a_wide_table(spark):
    names = ["it's", *[f"d_{i}" for i in range(1, 120)]]
    df = spark.createDataFrame([[None if i % 3 == r else float("nan") if i == 4 else 1.0 for i in range(120)] for r in range(2)], ", ".join(f"`{n}` double" for n in names))
    wide = {r.variable: (r.missing, r.percent) for r in cleaning.missing_summary(df).collect()}
    parts = [cleaning.missing_summary(df.select(*[f"`{n}`" for n in half])) for half in (names[:60], names[60:])]
    assert wide == {r.variable: (r.missing, r.percent) for part in parts for r in part.collect()}
    empty = cleaning.missing_summary(df.limit(0)).collect()
    assert len(empty) == 120 and all((r.missing, r.percent) == (0, None) for r in empty)


def test_duplicate_rows_and_keys(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "a int, b string")
    assert cleaning.duplicate_rows(df).first()[0] == 2
    assert rows(cleaning.duplicate_keys(df, ["a"])) == [(1, 3)]
    with pytest.raises(contracts.ContractError, match="duplicate"):
        checks.check_unique(df, ["a"])


def test_price_column_fallbacks(spark):
    older = spark.createDataFrame([(1.0,)], ["average_selling_price"])
    assert contracts.ensure_price_column(older).columns == ["average_price"]
    none = contracts.ensure_price_column(spark.range(1))
    assert dict(none.dtypes)["average_price"] == "double" and none.first().average_price is None
    with pytest.raises(contracts.ContractError, match="lacks columns: q"):
        contracts.require_columns(older, ["q"], "sales")


@pytest.mark.parametrize("days", [None, 40, 41])
def test_product_summary_against_dense_arithmetic(spark, days):
    rng = random.Random(days or 0)
    data = {item: [float(rng.choice([0, 0, 1, 1, 2, 5, 9])) for _ in range(rng.randint(5, 38))] for item in "abcde"}
    data["hot"] = [float(rng.randint(0, 3)) for _ in range(39)]
    records = [(item, "d", "c", v, v + 1 if v else None) for item, values in data.items() for v in values]
    df = spark.createDataFrame(records, "item_id string, dept_id string, cat_id string, sales double, sell_price double")
    got = {r.item_id: r for r in cleaning.product_summary(df, days).collect()}
    for item, values in data.items():
        dense = values + [0.0] * ((days or len(values)) - len(values))
        row = got[item]
        assert row.total_sales == sum(dense)
        assert row.average_daily_sales == pytest.approx(statistics.mean(dense))
        assert row.median_daily_sales == statistics.median(dense)
        assert row.zero_sales_pct == pytest.approx(100 * dense.count(0.0) / len(dense))
        assert row.active_days == sum(v > 0 for v in dense)
        priced = [v + 1 for v in values if v]
        assert row.average_price == (pytest.approx(statistics.mean(priced)) if priced else None)


def test_top_k_ties(spark):
    totals = [100, 90, 80, 70, 60, 50, 40, 30, 20, 10, 10, 5]
    df = spark.createDataFrame([(f"p{i:02d}", "c", float(v)) for i, v in enumerate(totals)], "item_id string, cat_id string, sales double")
    assert exploration.top_products(df, 10).count() == 11
    assert exploration.top_products_per_category(df, 10).count() == 11
    strict = exploration.top_k_strict(exploration.product_totals(df), "total_sales", 10, "item_id").collect()
    assert len(strict) == 10 and strict[-1].item_id == "p09"
    assert exploration.top_products(df, 50).count() == 12


def test_moving_average_needs_full_window(spark):
    start = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(i), float(i), 0.0) for i in range(40)], "date date, units_sold double, revenue double")
    got = {r.date: r.ma30 for r in exploration.daily_total_ma30(df).collect()}
    assert got[start + dt.timedelta(28)] is None
    assert got[start + dt.timedelta(29)] == pytest.approx(14.5)


def test_histogram_puts_the_upper_edge_in_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (2.4,), (2.5,), (100.0,)], ["zero_sales_pct"])
    got = {r.bin: r.products for r in exploration.intermittency_histogram(df).collect()}
    assert got == {0: 2, 1: 1, 39: 1}


def test_event_lift_needs_both_sides(spark):
    df = spark.createDataFrame([(1, 12.0), (0, 10.0)], "is_event int, units_sold double")
    assert reports.event_lift(df).first().lift_pct == 20.0
    assert reports.event_lift(df.where("is_event = 1")).first().lift_pct is None
    zero = spark.createDataFrame([(1, 12.0), (0, 0.0)], "is_event int, units_sold double")
    assert reports.event_lift(zero).first().lift_pct is None


def test_percent_label_drops_trailing_zeros(spark):
    df = spark.createDataFrame([(7.486,), (8.4,), (8.0,), (100.0,), (-0.544,), (None,)], "v double")
    assert [r[0] for r in df.select(percent_label("v")).collect()] == ["7.49%", "8.4%", "8%", "100%", "-0.54%", None]


def test_filter_panel_bounds_are_inclusive(spark):
    days = [(dt.date(2020, 1, d), "A" if d % 2 else "B") for d in range(1, 11)]
    df = spark.createDataFrame(days, "date date, cat_id string")
    assert reports.filter_panel(df, "2020-01-02", "2020-01-05").count() == 4
    assert reports.filter_panel(df, "2020-01-02", "2020-01-05", "All").count() == 4
    assert reports.filter_panel(df, "2020-01-02", "2020-01-05", "A").count() == 2


def test_csv_round_trip_reads_na_and_empty_as_null(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, None, 1.5)], "a int, b string, c double")
    io.write_table(df, str(tmp_path / "t.csv"))
    assert sorted(rows(io.read_table(spark, str(tmp_path / "t.csv"), schema=df.schema))) == sorted(rows(df))
    (tmp_path / "raw.csv").write_text("a,b,c\n1,NA,\n2,y,NA\n")
    got = io.read_table(spark, str(tmp_path / "raw.csv"), schema="a int, b string, c double")
    assert rows(got) == [(1, None, None), (2, "y", None)]


def test_csv_header_must_match_the_schema(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        io.read_table(spark, str(tmp_path / "raw.csv"), schema="a int, b int").collect()


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 1.5)
    stored = io.materialize(df)
    assert stored.schema.simpleString() == df.schema.simpleString()
    assert stored.exceptAll(df).isEmpty() and stored.count() == 100


def test_items_sold_need_no_shuffle_where_an_items_rows_lie_together(spark):
    """An item with several rows, one without sales and one without a name; the rows are dealt by item and week."""
    rows = [(1, 1, "a", 2.0, 6.0, 3.0), (1, 1, "a", 0.0, None, None), (1, 1, "b", 0.0, 0.0, 5.0), (1, 1, None, 4.0, 4.0, 1.0), (2, 1, "a", None, None, None)]
    df = spark.createDataFrame(rows, "day int, week int, item_id string, sales double, revenue double, sell_price double")
    daily = cleaning.daily_category_sales(df.repartition("item_id", "week"), ["day", "week"])
    got = {r.day: (r.units_sold, r.revenue, r.average_price, r.active_items) for r in daily.collect()}
    assert got == {1: (6.0, 10.0, pytest.approx((2 * 3.0 + 1 * 5.0 + 4 * 1.0) / 7), 1), 2: (None, 0.0, None, 0)}
    shuffles = daily._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")
    assert shuffles == 2
