"""Registered queries against their SQL twins on the smallest tables.

A selection runs by default; set PANELRY_ALL_QUERIES=1 for every query with a twin.
"""

import os

import pytest

import __spark_entry__ as contract
from compare import database, differences

SF_DIR = os.environ.get("PANELRY_SF_DIR", "/root/testdata/sf0.001")
SELECTION = [
    "daily_total_ma30", "daily_category_sales", "sales_profile", "product_summary", "top_products",
    "top_products_per_category", "event_calendar", "sales_history_features", "price_features", "all_model_metrics",
    "model_rankings", "residual_boxplot", "filter_choices", "median_imputed_features", "snake_columns",
]
STATEMENTS = {name: text for name, text in contract.oracle_sql().items() if name not in contract.LLM_ORACLES}
NAMES = list(STATEMENTS) if os.environ.get("PANELRY_ALL_QUERIES") else SELECTION


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    return database(SF_DIR)


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    without = set(contract.queries()) - set(STATEMENTS) - set(contract.LLM_QUERIES)
    assert without == {
        "ets_selection", "ets_forecast", "gbt_forecast", "gbt_importance", "top_importance", "forecasting_run_metrics",
    }


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_twin(spark, con, name):
    assert differences(contract.queries()[name](spark, SF_DIR), con, STATEMENTS[name]) == []
