"""Every named query against its independent DuckDB SQL (the driver's correctness gate).

All queries run at sf0.001; the ones whose edge cases only appear with more data
(duplicate order ids, ties, every daypart) run at sf0.01 as well.
"""

from __future__ import annotations

import pytest

from conftest import SF_CHECK, SF_SMALL
from oracle_compare import compare, duckdb_connection

import __spark_entry__
from campaign_analytics.plans import oracle, registry

ALL = list(registry.QUERIES)
AT_CHECK_SCALE = [
    "gold_layer",
    "quality_malformed",
    "kmeans_checks",
    "customer_groups",
    "abt",
    "group_kpis",
    "group_summary_share",
    "total_discount",
    "campaign_viability",
    "daypart_report",
    "daytype_report",
    "price_tier_report",
    "quality_repeated_orders",
    "latest_order",
    "scaled_features",
    "profile_group_summary",
    "customer_clusters",
    "fitted_profile_group_summary",
    "sql_abt",
    "catalog_gold",
    "gold_month_rewrite",
    "quality_observed",
    "undeclared_fields",
    "typed_items_variant",
    "bitmap_group_kpis",
    "streamed_latest_order",
    "top_merchant",
]


@pytest.fixture(scope="module")
def duck_small():
    return duckdb_connection(SF_SMALL)


@pytest.fixture(scope="module")
def duck_check():
    return duckdb_connection(SF_CHECK)


def test_every_query_has_sql():
    assert set(oracle.all_sql()) == set(ALL)


@pytest.mark.parametrize("name", ALL)
def test_query_matches_oracle_small(spark, duck_small, name):
    ok, msg = compare(spark, duck_small, name, SF_SMALL)
    assert ok, msg


@pytest.mark.parametrize("name", AT_CHECK_SCALE)
def test_query_matches_oracle_check_scale(spark, duck_check, name):
    ok, msg = compare(spark, duck_check, name, SF_CHECK)
    assert ok, msg


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    rows = df.collect()
    assert [c for c in df.columns] == [
        "ab_group",
        "customer_count",
        "order_count",
        "revenue",
        "avg_ticket",
        "revenue_per_customer",
    ]
    assert [r.ab_group for r in rows] == ["control", "target", "variant_b"]
