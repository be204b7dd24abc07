"""Exact distinct counts from stored bitmaps that can be merged.

Orders and customers have numbers; per A/B group and month the numbers that occur are kept as
bitmaps of 32,768 bits.  A report over any months merges the bitmaps and counts bits, instead
of scanning the orders and shuffling their ids again.  A new month adds its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import money
from .group_metrics import GROUP

#: What is counted: the kind in the stored rows, the id column, the name in the reports.
KINDS = {"order": ("order_id", "order_count"), "customer": ("customer_id", "customer_count")}
PERIOD = "order_month"


def number_ids(ids: DataFrame, column: str, path: str) -> DataFrame:
    """Numbers for the different values of an id column, as a table at ``path``: ``column``, ``number``.

    The ids are numbered one after the other within the partitions they are written in; the
    numbers are read back from the table, so they are the same for every later use.  Needed
    for ids that are no whole numbers from 0 on, or far apart.
    """
    known = ids.select(column).filter(F.col(column).isNotNull()).distinct()
    known.withColumn("number", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    return ids.sparkSession.read.parquet(path)


def with_numbers(orders: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
    """``orders`` with the ids of ``column`` replaced by their numbers (NULL stays NULL)."""
    named = numbers.select(F.col(column).alias("_id"), F.col("number").alias("_number"))
    joined = orders.join(named, F.col(column) == F.col("_id"), "left")
    return joined.select(*[F.col("_number").alias(c) if c == column else F.col(c) for c in orders.columns])


def bitmaps(orders: DataFrame, period: Column) -> DataFrame:
    """Stored rows: group, period, kind, bucket, bits, amount, amount_rows.

    ``orders`` has whole-number ids.  For each kind a row per bucket that occurs; and one row of
    kind ``amount`` with the exact sum of amounts and their number.
    """
    rows = orders.select(GROUP, period.alias(PERIOD), *[c for c, _ in KINDS.values()], "order_total_amount")
    ids = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, (c, _) in KINDS.items()]))
    each = rows.select(GROUP, PERIOD, ids).filter(F.col("id").isNotNull())
    bits = each.groupBy(GROUP, PERIOD, "kind", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
    )
    amount = money("order_total_amount")
    sums = rows.groupBy(GROUP, PERIOD).agg(F.sum(amount).alias("amount"), F.count(amount).alias("amount_rows"))
    return bits.unionByName(sums.withColumn("kind", F.lit("amount")), allowMissingColumns=True)


def merged_metrics(stored: DataFrame, months: list[str] | None = None) -> DataFrame:
    """The columns of ``group_metrics.group_metrics`` from stored rows, over all or the given periods.

    The reports of Q4-Q7 and Q9 are projections of this.
    """
    kept = stored if months is None else stored.filter(F.col(PERIOD).isin(months))
    merged = kept.groupBy(GROUP, "kind", "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"),
        F.sum("amount").alias("amount"),
        F.sum("amount_rows").alias("amount_rows"),
    )
    counts = [F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(name) for k, (_, name) in KINDS.items()]
    return merged.groupBy(GROUP).agg(
        *counts, F.sum("amount").alias("exact_revenue"), F.coalesce(F.sum("amount_rows"), F.lit(0)).alias("amount_rows")
    )
