"""The two layer jobs: raw orders -> silver orders, silver tables -> gold ABT.

Each job reads its inputs, applies the operators, and writes one table; the written
table is what later jobs read, which also cuts the lineage (a lost executor during an
analysis recomputes from the gold files, not from the raw JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import quality
from ..operators.ingest import keep_latest_order, type_orders
from ..operators.joins import HOT_KEY_ROWS, build_abt
from ..sources.readers import read_dimension_csv, read_layer, read_raw_orders
from ..sources.writers import write_layer


def silver_orders(
    spark: SparkSession,
    raw_path: str,
    silver_location: str,
    partitions: int | None = None,
    keep_latest: bool = False,
) -> None:
    """S1 -> P1-P3 (-> D3 when ``keep_latest``) -> S4."""
    typed = type_orders(read_raw_orders(spark, raw_path, partitions))
    if keep_latest:
        typed = keep_latest_order(typed)
    write_layer(typed, silver_location)


def silver_orders_observed(
    spark: SparkSession, raw_path: str, silver_location: str, quality_location: str, partitions: int | None = None
) -> None:
    """S1 -> P1-P3 -> S4, and beside it a small table of what was lost, from the same scan."""
    seen = Observation()
    raw = read_raw_orders(spark, raw_path, partitions, keep_corrupt=True)
    write_layer(quality.type_observed(raw, seen), silver_location)
    write_layer(quality.observed_rows(spark, seen.get), quality_location)


def silver_dimension(spark: SparkSession, csv_path: str, schema: T.StructType, silver_location: str) -> None:
    """S3 -> silver: a header CSV dimension typed by name and written as Parquet once, so
    every later join reads typed columnar data instead of re-parsing text."""
    write_layer(read_dimension_csv(spark, csv_path, schema), silver_location)


def gold_abt(
    orders: DataFrame,
    consumer: DataFrame,
    ab_test_ref: DataFrame,
    restaurant: DataFrame,
    gold_location: str,
    hot_key_rows: int = HOT_KEY_ROWS,
) -> None:
    """J2 -> S5: the analytical base table, rows of one customer kept together per file."""
    abt = build_abt(orders, consumer, ab_test_ref, restaurant, hot_key_rows)
    write_layer(abt, gold_location, sort_within=["customer_id"])


#: The gold table by month: the column its folders are named by, and the name for orders without a time.
MONTH, NO_MONTH = "order_month", "none"


def month_of(time: str = "order_created_at") -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit(NO_MONTH))


def gold_months(
    orders: DataFrame,
    consumer: DataFrame,
    ab_test_ref: DataFrame,
    restaurant: DataFrame,
    gold_path: str,
    months: list[str] | None = None,
    hot_key_rows: int = HOT_KEY_ROWS,
) -> None:
    """J2 -> S5 by month of order: writes the folders of ``months`` (all, if not given) and no others.

    A rerun replaces the rows of its months; the other months' files stay as they are.  A given
    month that has no order any more is left with an empty folder.  The rows of a month are
    gathered before the write, so that not every task writes every month; AQE splits a large
    month over several tasks.
    """
    kept = orders if months is None else orders.filter(month_of().isin(months))
    abt = build_abt(kept, consumer, ab_test_ref, restaurant, hot_key_rows).withColumn(MONTH, month_of())
    seen = Observation()
    rows = abt.hint("rebalance", F.col(MONTH)).observe(seen, F.collect_set(MONTH).alias("months"))
    write_layer(rows, gold_path, sort_within=["customer_id"], partition_by=[MONTH], only_these_partitions=True)
    empty = orders.sparkSession.createDataFrame([], abt.drop(MONTH).schema)
    for month in sorted(set(months or []) - set(seen.get["months"])):
        write_layer(empty, f"{gold_path.rstrip('/')}/{MONTH}={month}")


def read_gold(spark: SparkSession, gold_location: str, months: list[str] | None = None) -> DataFrame:
    """The gold table; of one written by month only the folders of ``months``, if given."""
    gold = read_layer(spark, gold_location)
    return gold if months is None else gold.filter(F.col(MONTH).isin(months))
