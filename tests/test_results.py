"""Registered queries against DuckDB. All of them with COLWRIGHT_ALL=1."""

import os

import pytest

from checks.compare import check, connect
from checks.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
QUICK = (
    "profile_dirty", "semantic_types_insight", "numeric_stats", "categorical_stats_dirty",
    "top_values", "correlation_with_gaps", "preflight", "csv_roundtrip", "grouped_aggregates",
    "refined_actions", "clean_convert_annual_income", "clean_full", "cleaning_summary",
    "change_totals", "problem_cells", "insight_cat_cat", "insight_trend", "chart_histogram",
    "chart_pie", "chart_filtered", "filtered_rows",
)
NAMES = tuple(QUERIES) if os.environ.get("COLWRIGHT_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert check(spark, con, SF, name, QUERIES[name], SQL.get(name)) is None
