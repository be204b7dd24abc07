"""A/B group KPIs over the exploratory join (Q1-Q3) and the ABT (Q4-Q8).

Every report names its columns; :mod:`group_metrics` computes them from one aggregation by
group.  Plain sums are combined in each task before the shuffle; distinct counts are planned
by Catalyst in two phases (first on ``(group, order_id)``, then on the group), so the shuffle
is spread over the distinct keys, not over the two groups.

``explore_reports`` and ``ab_reports`` give the whole family from one pass over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import DEFAULT_COUPON_VALUE, order_discount
from . import viability
from .group_metrics import GROUP, group_metrics, report
from .reporting import Bundle, sorted_report

#: Columns of each report on the exploratory join (a NULL group is kept) and on the ABT.
EXPLORE_REPORTS = {
    "group_order_share": [GROUP, "order_count", "order_pct"],
    "group_revenue_share": [GROUP, "revenue", "revenue_pct"],
    "group_summary_raw": [GROUP, "order_count", "revenue", "avg_ticket"],
}
AB_REPORTS = {
    "group_kpis": [GROUP, "customer_count", "order_count", "revenue", "avg_ticket", "revenue_per_customer"],
    "group_customers": [GROUP, "customer_count"],
    "group_summary_share": [
        GROUP, "customer_count", "order_count", "revenue", "avg_ticket", "order_pct", "revenue_pct",
    ],
    "orders_per_customer": [GROUP, "order_count", "customer_count", "orders_per_customer"],
}
#: Reports whose rows come in order of the group.
IN_ORDER = {"group_kpis"}


def _finished(name: str, metrics: DataFrame, columns: list[str]) -> DataFrame:
    rows = report(metrics, *columns)
    return sorted_report(rows, GROUP) if name in IN_ORDER else rows


def explore_report(x: DataFrame, name: str) -> DataFrame:
    """One of Q1-Q3: orders, revenue, ticket and percentages per group of the exploratory join."""
    return _finished(name, group_metrics(x), EXPLORE_REPORTS[name])


def ab_report(abt: DataFrame, name: str) -> DataFrame:
    """One of Q4-Q7: customers, orders, revenue and ratios per group of the ABT."""
    return report_of(_of_known_customers(abt), name)


def report_of(metrics: DataFrame, name: str) -> DataFrame:
    """One of Q4-Q7 from the rows of ``group_metrics.group_metrics``, wherever they come from."""
    return _finished(name, metrics, AB_REPORTS[name])


def _of_known_customers(abt: DataFrame) -> DataFrame:
    return group_metrics(abt.filter(F.col("customer_id").isNotNull()))


def _kept(metrics: DataFrame) -> DataFrame:
    # Two or three rows: one partition (a cached plan keeps its partitioning).
    return metrics.coalesce(1).cache()


def explore_reports(x: DataFrame) -> Bundle:
    """Q1-Q3 from a single pass over the exploratory join."""
    metrics = _kept(group_metrics(x))
    return Bundle(metrics, {name: _finished(name, metrics, columns) for name, columns in EXPLORE_REPORTS.items()})


def ab_reports(abt: DataFrame, coupon_value: float = DEFAULT_COUPON_VALUE) -> Bundle:
    """Q4-Q7 and Q9 from a single pass over the ABT."""
    metrics = _kept(_of_known_customers(abt))
    reports = {name: _finished(name, metrics, columns) for name, columns in AB_REPORTS.items()}
    return Bundle(metrics, reports | {"campaign_viability": viability.compare_groups(metrics, coupon_value)})


def order_discounts(abt: DataFrame, strict_nulls: bool = False) -> DataFrame:
    """Per order row: number of parsed items and the exact discount fold (P1 + H1)."""
    return abt.select(
        "order_id",
        F.when(F.col("items").isNotNull(), F.size("items")).alias("item_count"),
        order_discount("items", strict_nulls).cast("double").alias("order_discount"),
    )


def total_discount(abt: DataFrame, strict_nulls: bool = False) -> DataFrame:
    """Q8: one row, the sum of every order's discount fold (orders with NULL fold skipped)."""
    return abt.agg(F.sum(order_discount("items", strict_nulls)).cast("double").alias("total_discount"))
