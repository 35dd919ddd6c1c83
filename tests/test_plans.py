"""Plan shapes that must hold at any scale."""

import os
import re

import pytest

from panelry.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["sales_complete", "daily_category_sales", "category_features", "product_features", "product_summary",
     "unpivot_daily_sales", "top_products", "all_model_metrics", "overview_kpis", "seasonal_naive_forecast"],
)
def test_no_cross_join(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


def test_product_windows_share_one_shuffle(spark):
    text = plan(spark, "product_features")
    assert len(re.findall(r"Exchange hashpartitioning\(item_id#\d+L, \d+\)", text)) == 1
    assert "LeftSemi" in text


def test_group_top_k_is_limited_before_the_shuffle(spark):
    text = plan(spark, "top_products_per_category")
    assert re.search(r"WindowGroupLimit.*Partial", text) and re.search(r"WindowGroupLimit.*Final", text)


def test_global_top_k_has_no_unpartitioned_rank(spark):
    text = plan(spark, "top_products")
    assert "TakeOrderedAndProject" in text and "Window" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(spark, "top_products")
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", text)
    assert schemas and all("l_comment" not in s and "l_tax" not in s and "l_orderkey" not in s for s in schemas)


def test_no_python_outside_smoothing(spark):
    for name in ("category_features", "product_features", "all_model_metrics", "product_summary"):
        assert not re.search("Python|ArrowEval|Pandas", plan(spark, name))


def reads_of_lines(df):
    """Scans of the sales lines in the plans that ran: exchanges and subqueries that were reused have none."""
    df.collect()
    reads, open_plans = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = re.search(r"[A-Za-z=*(]", line)
        while open_plans and at and at.start() < open_plans[-1][0]:
            open_plans.pop()
        if "== Final Plan ==" in line:
            open_plans.append([at.start(), True])
        elif "== Initial Plan ==" in line and open_plans:
            open_plans[-1][1] = False
        elif "FileScan parquet [l_" in line:
            reads += all(final for _, final in open_plans)
    return reads


@pytest.mark.parametrize("name, most", [("daily_total_ma30", 2), ("category_mix", 2), ("overview_kpis", 3), ("category_features", 3)])
def test_few_reads_of_the_lines(spark, name, most):
    """One for the facts, one narrow one for the days; where asked, one for item numbers or recorded prices."""
    assert 1 <= reads_of_lines(QUERIES[name](spark, SF_DIR)) <= most


def test_wide_tables_gather_only_days_with_lines(spark):
    """Empty days come after the only aggregate of a series: one explode, that of the unpivot itself."""
    assert plan(spark, "unpivot_store_sales").split("== Initial Plan ==")[0].count("Generate ") == 1


def test_category_panel_deals_the_lines_once(spark):
    """One exchange by item and week for sales, prices and items sold, one by item for the recorded prices of earlier weeks."""
    keyed = re.findall(r"Exchange hashpartitioning\(([^)]*item_id[^)]*), \d+\)", plan(spark, "category_features"))
    assert sorted(re.sub(r"#\d+L?", "", k) for k in keyed) == ["item_id", "item_id, wm_yr_wk"]
