"""A spread of registered queries against their SQL at the smallest scale (all of them: tests/compare.py)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "ag01_storage_by_area", "sc02_inventory_union", "jn04_attach_loose", "pf10_validate_key", "fn14_fill_text", "cq19_extract_scenarios",
    "tk04_best_profile", "ag07_best_collection", "cq09_validate_plan", "jn12_cell_diff", "tk07_kb_passages", "fn36_kb_codes", "tk06_kb_scope", "sc13_run_artifacts",
    "ss01_activity_stream", "ss03_session_stream", "cq14_line_changes", "ud03_extract_items",
)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees(spark, con, name):
    good, message = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql().get(name))
    assert good, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
