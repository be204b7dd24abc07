
from __future__ import annotations

import pytest

from campaign_analytics.operators import kpis, segments, viability
from campaign_analytics.plans import registry
from conftest import SF_CHECK


@pytest.fixture(scope="module")
def abt_a(spark):
    return registry.abt_a(spark, SF_CHECK).cache()


@pytest.fixture(scope="module")
def abt_b(spark):
    return registry.abt_b(spark, SF_CHECK).cache()


def test_shares_sum_to_100(spark, abt_a):
    x = registry.explore_a(spark, SF_CHECK)
    for df, col in ((kpis.explore_report(x, "group_order_share"), "order_pct"), (kpis.explore_report(x, "group_revenue_share"), "revenue_pct"),
                    (kpis.ab_report(abt_a, "group_summary_share"), "order_pct"), (kpis.ab_report(abt_a, "group_summary_share"), "revenue_pct")):
        rows = df.collect()
        assert abs(sum(r[col] for r in rows) - 100.0) <= 0.01 * len(rows)


def test_exploratory_join_keeps_null_group(spark):
    rows = kpis.explore_report(registry.explore_a(spark, SF_CHECK), "group_order_share").collect()
    assert None in {r.ab_group for r in rows}


def test_abt_not_larger_than_silver_with_unique_keys(spark, abt_a):
    assert abt_a.count() <= registry.silver_orders_a(spark, SF_CHECK).count()
    assert abt_a.filter("customer_id IS NULL OR ab_group IS NULL").count() == 0


@pytest.mark.parametrize("report", [segments.DAYPART, segments.DAY_TYPE])
def test_segment_reports_add_up_to_customer_metrics(spark, abt_b, report):
    metrics = segments.customer_metrics(abt_b).collect()
    rep = segments.label_report(abt_b, report).collect()
    assert sum(r.customer_count for r in rep) == len(metrics)
    assert sum(r.order_count for r in rep) == sum(m.order_count for m in metrics)
    assert abs(sum(r.revenue for r in rep) - sum(m.revenue for m in metrics)) <= 0.01 * len(rep)


def test_price_tier_report_adds_up(spark, abt_a):
    metrics = segments.customer_metrics(abt_a).collect()
    rep = segments.price_tier_report(abt_a).collect()
    assert sum(r.customer_count for r in rep) == len(metrics)


def test_viability_identities_on_data(spark, abt_a):
    v = viability.campaign_viability(abt_a).first()
    assert abs(v.net_total - (v.incremental_revenue - v.campaign_cost)) <= 0.011
    assert abs(v.net_per_customer - (v.incremental_revenue_estimated - v.campaign_cost)) <= 0.011
    assert v.campaign_cost == 10.0 * v.target_order_count


def test_one_pass_reports_equal_single_reports(spark, abt_a):
    combined = kpis.ab_reports(abt_a)
    single = {name: kpis.ab_report(abt_a, name) for name in kpis.AB_REPORTS}
    single["campaign_viability"] = viability.campaign_viability(abt_a)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    for name, df in single.items():
        got = combined[name]
        assert sorted(got.columns) == sorted(df.columns), name
        cols = sorted(df.columns)
        assert sorted(got.select(*cols).collect(), key=key) == sorted(df.select(*cols).collect(), key=key), name


@pytest.mark.parametrize("which", ["abt_a", "abt_b"])
def test_one_pass_segment_reports_equal_single_reports(spark, abt_a, abt_b, which):
    abt = abt_a if which == "abt_a" else abt_b
    combined = segments.segment_reports(abt)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    for name, df in combined.items():
        labelling = {"daypart_report": segments.DAYPART, "daytype_report": segments.DAY_TYPE}.get(name)
        single = segments.label_report(abt, labelling) if labelling else segments.price_tier_report(abt)
        assert df.columns == single.columns, name
        assert sorted(df.collect(), key=key) == sorted(single.collect(), key=key), name


def test_one_pass_explore_reports_equal_single_reports(spark):
    x = registry.explore_a(spark, SF_CHECK).cache()
    combined = kpis.explore_reports(x)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    for name, df in combined.items():
        single = kpis.explore_report(x, name)
        assert df.columns == single.columns, name
        assert sorted(df.collect(), key=key) == sorted(single.collect(), key=key), name
