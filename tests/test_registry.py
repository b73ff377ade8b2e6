"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = (
    "validate_input clean_transactions engineer_features categorize_keywords anomaly_duplicate anomaly_scores cost_spikes "
    "subscriptions dashboard_summary fraud_duplicate fraud_near_duplicate fraud_no_transaction close_vendors "
    "audit_scan compliance_summary extract_totals extract_layouts stream_daily_counts dedupe_by_content transactions_last_page scan_transactions"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 90


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    ok, text = compare(spark, connect(SF), SF, entry_module.queries()[name], entry_module.oracle_sql()[name])
    assert ok, text


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
