"""Registered queries against their DuckDB oracles on the smallest given tables (sf0.001)."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

FAST = ["html_rule_match", "meta_tags", "script_srcs", "data_attributes", "header_fold", "cookie_first_wins",
        "header_match", "script_match", "js_global_match", "tech_with_implied", "endpoints_merged",
        "external_deps", "ct_subdomains", "subdomain_tech", "wordlist_manifest", "dom_from_requests",
        "stream_request_pairing", "stream_domain_windows", "stream_detect", "exposed_paths", "endpoints_all",
        "scan_summary", "tech_report"]


@pytest.fixture(scope="module")
def con():
    return duck("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, "/root/testdata/sf0.001", name, verbose=True)


def test_every_query_has_a_callable_and_entry_runs(spark):
    qs = entry.queries()
    assert len(qs) >= 50
    df = entry.entry(spark)
    assert df.count() > 0
