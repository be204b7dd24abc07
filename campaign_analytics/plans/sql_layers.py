"""The layers as SQL tables, and the two joins as parameterised SQL text.

The layers are temporary views or catalog tables; a query names them through
``IDENTIFIER(:orders)`` and takes its values as ``:markers``, so no text is pasted into SQL.
The text runs through the same optimiser as the DataFrame joins: the null filter and the
period reach the scan, and joins broadcast by Spark's own threshold.  Hot keys are left to
AQE's skew handling here; :mod:`campaign_analytics.operators.joins` salts them.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "consumer", "ab_test_ref", "restaurant")

_PERIOD = """(:since IS NULL OR p.order_created_at >= :since) AND (:until IS NULL OR p.order_created_at < :until)"""

EXPLORE = f"""
SELECT p.*, c.created_at AS customer_created_at, c.active, ab.is_target AS ab_group
FROM IDENTIFIER(:orders) p
LEFT JOIN IDENTIFIER(:consumer) c ON c.customer_id = p.customer_id
LEFT JOIN IDENTIFIER(:ab_test_ref) ab ON ab.customer_id = p.customer_id
LEFT JOIN IDENTIFIER(:restaurant) r ON r.id = p.merchant_id
WHERE {_PERIOD}
"""

ABT = f"""
SELECT p.*, ab.is_target AS ab_group, c.created_at AS customer_created_at, c.active,
       r.created_at AS merchant_created_at, r.enabled AS merchant_enabled, r.price_range AS merchant_price_range,
       r.average_ticket AS merchant_average_ticket, r.delivery_time AS merchant_delivery_time,
       r.minimum_order_value AS merchant_minimum_order_value, r.merchant_city, r.merchant_state
FROM IDENTIFIER(:orders) p
INNER JOIN IDENTIFIER(:ab_test_ref) ab ON ab.customer_id = p.customer_id
LEFT JOIN IDENTIFIER(:consumer) c ON c.customer_id = p.customer_id
LEFT JOIN IDENTIFIER(:restaurant) r ON r.id = p.merchant_id
WHERE p.customer_id IS NOT NULL AND {_PERIOD}
"""


def register_views(tables: Mapping[str, DataFrame], prefix: str | None = None) -> dict[str, str]:
    """A temporary view per table; returns the view's name by table.

    Without ``prefix`` the names are new ones, so two callers in a session do not meet.
    """
    prefix = prefix or f"layer_{uuid.uuid4().hex}"
    names = {name: f"{prefix}_{name}" for name in tables}
    for name, df in tables.items():
        df.createOrReplaceTempView(names[name])
    return names


def catalog_names(database: str) -> dict[str, str]:
    """The silver tables of a catalog database, by table."""
    return {name: f"{database}.{name}" for name in TABLES}


def query(spark: SparkSession, text: str, names: Mapping[str, str], **values) -> DataFrame:
    """``text`` over the layers: ``IDENTIFIER(:table)`` for each of ``names``, ``:value`` for each value."""
    return spark.sql(text, args={**names, **values})


def explore_join(
    spark: SparkSession, names: Mapping[str, str], since: datetime | None = None, until: datetime | None = None
) -> DataFrame:
    """J1 from SQL text: all orders with their customer and group, of a period if given (``until`` excluded)."""
    return query(spark, EXPLORE, names, since=since, until=until)


def build_abt(
    spark: SparkSession, names: Mapping[str, str], since: datetime | None = None, until: datetime | None = None
) -> DataFrame:
    """J2 from SQL text: the gold order table, of a period if given (``until`` excluded)."""
    return query(spark, ABT, names, since=since, until=until)
