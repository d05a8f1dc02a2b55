"""Registered queries on sf0.001 with small blocks, against DuckDB.

`python tests/oracle_check.py` runs all of them on sf0.01.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"
ORDERED = [
    "aggregate", "quantiles", "average_rank", "lag_and_difference", "kpi", "describe", "ecdf", "runs_test", "individuals_chart",
    "individuals_chart_staged", "run_rules_all", "xbar_r_chart", "attribute_chart_p_laney", "ewma_chart", "cusum_chart",
    "moving_average_chart", "zmr_chart", "press_and_durbin_watson", "autocorrelation", "decomposition", "differencing",
    "single_smoothing", "holt", "moving_average_centered", "hotelling_t2_subgroups", "ols_summary", "variance_components",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


def test_every_query_has_a_callable():
    q, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= q.keys() and len(q) > 200


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ORDERED)
def test_matches_sql(spark, name):
    text, ok = compare(spark, duck(FOLDER), name, FOLDER)
    assert ok, text
