"""Q9: campaign viability - incremental revenue of the target group against coupon cost.

The base metrics are one aggregation by group; the comparison is a second aggregation
over those (two or three) rows with conditional sums, so the answer is a one-row
DataFrame and nothing is taken to the driver.  A missing group gives NULL outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import CONTROL, DEFAULT_COUPON_VALUE, TARGET, round2
from .group_metrics import GROUP, group_metrics, per, revenue


def campaign_viability(abt: DataFrame, coupon_value: float = DEFAULT_COUPON_VALUE) -> DataFrame:
    """One row: both groups' metrics, incremental revenue three ways, cost and net results.

    * incremental_revenue           = revenue_T - revenue_C
    * incremental_revenue_per_customer = revenue_T/customers_T - revenue_C/customers_C
    * incremental_revenue_estimated = that difference x customers_T
    * campaign_cost                 = coupon_value x orders_T (every target order uses one)
    * net_total / net_per_customer  = the total / estimated increment minus the cost
    """
    return compare_groups(group_metrics(abt), coupon_value)


def compare_groups(metrics: DataFrame, coupon_value: float = DEFAULT_COUPON_VALUE) -> DataFrame:
    """The one-row comparison from the rows of :func:`group_metrics.group_metrics`."""
    measures = {
        "order_count": F.col("order_count"),
        "customer_count": F.col("customer_count"),
        "revenue": revenue(),
        "avg_ticket": per(revenue(), "order_count"),
        "revenue_per_customer": per(revenue(), "customer_count"),
    }
    wide = metrics.agg(
        *[
            F.max(F.when(F.col(GROUP) == label, value)).alias(f"{side}_{name}")
            for side, label in (("target", TARGET), ("control", CONTROL))
            for name, value in measures.items()
        ]
    )
    inc_per_customer = F.col("target_revenue_per_customer") - F.col("control_revenue_per_customer")
    wide = (
        wide.withColumn("incremental_revenue", F.col("target_revenue") - F.col("control_revenue"))
        .withColumn("incremental_revenue_per_customer", inc_per_customer)
        .withColumn("incremental_revenue_estimated", inc_per_customer * F.col("target_customer_count"))
        .withColumn("campaign_cost", F.lit(float(coupon_value)) * F.col("target_order_count"))
    )
    wide = wide.withColumn("net_total", F.col("incremental_revenue") - F.col("campaign_cost")).withColumn(
        "net_per_customer", F.col("incremental_revenue_estimated") - F.col("campaign_cost")
    )
    money_cols = [c for c, t in wide.dtypes if t == "double"]
    return wide.select(*[round2(c).alias(c) if c in money_cols else F.col(c) for c in wide.columns])
