"""Registered queries against their SQL at the smallest scale.

By default one query of each kind; FORMLOOM_FULL=1 runs them all.
"""

import os

import pytest

import __spark_entry__ as contract
from check import compare, connect
from formloom.plans.catalog import all_entries

SF = "/root/testdata/sf0.001"
QUICK = (
    "form_wide_rows", "cell_contents", "amounts", "redacted_paths", "adjacent_gaps", "reconciled_sources", "budget_gate",
    "streamed_page_states", "shift_estimates", "line_segments", "frame_ledger", "response_symbols",
)
NAMES = list(all_entries()) if os.environ.get("FORMLOOM_FULL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    count, ok, why = compare(spark, con, all_entries()[name], SF)
    assert ok is not False, why
    assert count > 0


def test_contract():
    assert contract.oracle_sql().keys() <= contract.queries().keys()
    own = all_entries().keys()
    assert (contract.queries().keys() & own) == contract.oracle_sql().keys() & own
