"""Command-line jobs for spark-submit: the ETL notebook and the analysis notebook.

    spark-submit campaign_analytics/jobs.py silver  --raw-orders RAW --raw-dims DIR --out SILVER
    spark-submit campaign_analytics/jobs.py gold    --silver SILVER --out GOLD
    spark-submit campaign_analytics/jobs.py reports --silver SILVER --gold GOLD --out REPORTS

``silver --quality DIR`` also writes what the silver write itself counted as lost, and ``gold --by-month``
writes the gold table by month of order; with ``--months 2019-01,2019-02`` only those are written anew.
``--raw-dims`` holds ``consumer.csv``, ``ab_test_ref.csv`` and ``restaurant.csv`` (files or
folders).  Every report is written as its own Parquet folder under ``--out``; the
session (master, shuffle partitions, ``spark.checkpoint.dir``) comes from spark-submit.
"""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from campaign_analytics import schemas  # noqa: E402
from campaign_analytics.operators import exact_kmeans, joins, kpis, profiles, quality, segments  # noqa: E402
from campaign_analytics.plans import layers  # noqa: E402
from campaign_analytics.session import BASE_CONF  # noqa: E402
from campaign_analytics.sources.readers import read_raw_orders  # noqa: E402
from campaign_analytics.sources.writers import write_layer  # noqa: E402

DIMENSIONS = {"consumer": schemas.CONSUMER, "ab_test_ref": schemas.AB_TEST_REF, "restaurant": schemas.RESTAURANT}


def _dims(spark: SparkSession, silver: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{silver}/{name}") for name in DIMENSIONS)


def run_silver(
    spark: SparkSession,
    raw_orders: str,
    raw_dims: str,
    out: str,
    keep_latest: bool = False,
    quality_out: str | None = None,
) -> None:
    for name, schema in DIMENSIONS.items():
        layers.silver_dimension(spark, f"{raw_dims}/{name}.csv", schema, f"{out}/{name}")
    if quality_out and not keep_latest:
        layers.silver_orders_observed(spark, raw_orders, f"{out}/orders", quality_out)
        return
    layers.silver_orders(spark, raw_orders, f"{out}/orders", keep_latest=keep_latest)
    if quality_out:  # keeping the latest shuffles, so the lost values are counted by a scan of their own
        write_layer(quality.malformed_orders(read_raw_orders(spark, raw_orders, keep_corrupt=True)), quality_out)


def run_gold(
    spark: SparkSession, silver: str, out: str, by_month: bool = False, months: list[str] | None = None
) -> None:
    tables = spark.read.parquet(f"{silver}/orders"), *_dims(spark, silver)
    if by_month or months:
        layers.gold_months(*tables, out, months)
    else:
        layers.gold_abt(*tables, out)


def run_reports(
    spark: SparkSession,
    silver: str,
    gold: str,
    out: str,
    time_zone: str | None = None,
    seeds: list[int] | None = None,
) -> list[str]:
    orders = spark.read.parquet(f"{silver}/orders")
    consumer, ab_test_ref, restaurant = _dims(spark, silver)
    abt = layers.read_gold(spark, gold)
    inputs = profiles.cluster_input(profiles.customer_features(abt))
    # with seeds, Spark ML's k-means from random starts; else the exact one, the same at every run
    labelled = profiles.fit_clusters(inputs, seeds=seeds) if seeds else exact_kmeans.fit_clusters(inputs)
    bundles = [
        kpis.explore_reports(joins.explore_join(orders, consumer, ab_test_ref, restaurant)),
        kpis.ab_reports(abt),
        profiles.profile_reports(labelled),
    ]
    reports: dict[str, DataFrame] = {name: df for bundle in bundles for name, df in bundle.items()}
    reports["total_discount"] = kpis.total_discount(abt)
    reports.update(segments.segment_reports(abt, time_zone))
    reports["top_merchant"] = segments.dominant_value(abt, "merchant_id")
    reports["top_city"] = segments.dominant_value(abt, "merchant_city")
    reports["quality_missing_consumer"] = quality.missing_consumer(orders, ab_test_ref, consumer)
    reports["quality_null_customer"] = quality.null_customer(orders)
    reports["quality_repeated_orders"] = quality.repeated_orders(orders)
    reports["quality_duplicate_keys"] = quality.duplicate_keys(
        {
            "consumer": (consumer, "customer_id"),
            "ab_test_ref": (ab_test_ref, "customer_id"),
            "restaurant": (restaurant, "id"),
        }
    )
    for name, df in reports.items():
        write_layer(df, f"{out}/{name}")
    for bundle in bundles:
        bundle.release()
    return sorted(reports)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="campaign_analytics.jobs")
    sub = parser.add_subparsers(dest="job", required=True)
    s = sub.add_parser("silver")
    s.add_argument("--raw-orders", required=True)
    s.add_argument("--raw-dims", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--keep-latest", action="store_true", help="keep only the latest row per order id (D3)")
    s.add_argument("--quality", default=None, help="folder for the counts of what was lost")
    g = sub.add_parser("gold")
    g.add_argument("--silver", required=True)
    g.add_argument("--out", required=True)
    g.add_argument("--by-month", action="store_true", help="write the gold table by month of order")
    g.add_argument("--months", default=None, help="comma-separated months (yyyy-MM) to write anew")
    r = sub.add_parser("reports")
    r.add_argument("--silver", required=True)
    r.add_argument("--gold", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--time-zone", default=None, help="segment hours in this zone (default: session zone)")
    r.add_argument("--kmeans-seeds", default=None, help="comma-separated seeds: fits from random starts, the lowest cost kept")
    args = parser.parse_args(argv)

    builder = SparkSession.builder.appName(f"campaign-analytics-{args.job}")
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if args.job == "silver":
        run_silver(spark, args.raw_orders, args.raw_dims, args.out, args.keep_latest, args.quality)
    elif args.job == "gold":
        run_gold(spark, args.silver, args.out, args.by_month, args.months.split(",") if args.months else None)
    else:
        seeds = [int(x) for x in args.kmeans_seeds.split(",")] if args.kmeans_seeds else None
        run_reports(spark, args.silver, args.gold, args.out, args.time_zone, seeds)


if __name__ == "__main__":
    main()
