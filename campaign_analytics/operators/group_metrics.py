"""The one aggregation by A/B group that every group report is a projection of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import money, round2, share_pct

GROUP = "ab_group"


def group_metrics(orders: DataFrame) -> DataFrame:
    """Per group: distinct orders and customers, the exact sum of amounts, and their number.

    Two or three rows.  A report that uses fewer of them computes fewer: Catalyst prunes the
    aggregates that the projection above does not read.
    """
    measures = {
        "order_count": F.countDistinct("order_id"),
        "exact_revenue": F.sum(money("order_total_amount")),
        "amount_rows": F.count(money("order_total_amount")),
    }
    if "customer_id" in orders.columns:
        measures["customer_count"] = F.countDistinct("customer_id")
    return orders.groupBy(GROUP).agg(*[m.alias(name) for name, m in measures.items()])


def revenue() -> Column:
    return F.col("exact_revenue").cast("double")


def per(amount: Column, count: str) -> Column:
    """``amount`` for each of ``count``; NULL if there are none."""
    return F.try_divide(amount, F.col(count).cast("double"))


def percent_of_all(value: Column) -> Column:
    """A group's part of the sum over all groups, in percent; NULL if the sum is zero.

    The window spans the report's rows, one per group.
    """
    return share_pct(value.cast("double"), F.sum(money(value)).over(Window.partitionBy()).cast("double"))


def report_columns() -> dict[str, Column]:
    """Columns of the reports, by name, over the rows of :func:`group_metrics`."""
    earned = round2(revenue())
    orders, customers = F.col("order_count"), F.col("customer_count")
    return {
        GROUP: F.col(GROUP),
        "order_count": orders,
        "customer_count": customers,
        "order_pct": percent_of_all(orders),
        "revenue": earned,
        "revenue_pct": percent_of_all(earned),
        "avg_ticket": round2(per(revenue(), "amount_rows")),
        "revenue_per_customer": round2(per(revenue(), "customer_count")),
        "orders_per_customer": round2(per(orders.cast("double"), "customer_count")),
    }


def report(metrics: DataFrame, *columns: str) -> DataFrame:
    """The named columns for every group of ``metrics``."""
    known = report_columns()
    return metrics.select(*[known[c].alias(c) for c in columns])
