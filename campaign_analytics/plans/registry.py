"""Named queries over the test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each query builds the order model from the test tables (``sources.testviews``), types it,
builds the exploratory join or the ABT, and applies one operator.  The result is a DataFrame
still to be run; small jobs run while it is built (sizes of the dimensions, the list of A/B
labels, hot keys, feature statistics), and the layer queries write and read files in a folder
of the session's checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.expressions import exact_sum, round2
from ..operators import (
    distinct_bitmaps,
    exact_kmeans,
    ingest,
    joins,
    kpis,
    open_schema,
    profiles,
    quality,
    segments,
    viability,
)
from ..operators.reporting import with_positions
from ..session import ensure_checkpoint_dir
from ..sources import readers
from ..sources import testviews as tv
from ..sources.writers import write_layer
from ..streaming import latest
from . import layers, sql_layers

Query = Callable[[SparkSession, str], DataFrame]


def silver_orders_a(spark: SparkSession, d: str) -> DataFrame:
    return ingest.type_orders(tv.orders_a_raw(spark, d))


def silver_orders_b(spark: SparkSession, d: str) -> DataFrame:
    return ingest.type_orders(tv.orders_b_raw(spark, d))


def _dims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tv.consumer(spark, d), tv.ab_test_ref(spark, d), tv.restaurant(spark, d)


def explore_a(spark: SparkSession, d: str) -> DataFrame:
    return joins.explore_join(silver_orders_a(spark, d), *_dims(spark, d))


def abt_a(spark: SparkSession, d: str) -> DataFrame:
    return joins.build_abt(silver_orders_a(spark, d), *_dims(spark, d))


def abt_b(spark: SparkSession, d: str) -> DataFrame:
    return joins.build_abt(silver_orders_b(spark, d), *_dims(spark, d))


def _cluster_input_a(spark: SparkSession, d: str) -> DataFrame:
    return profiles.cluster_input(profiles.customer_features(abt_a(spark, d)))


def fixed_clusters(inputs: DataFrame, k: int = profiles.DEFAULT_K) -> DataFrame:
    """Labels ``customer_id mod k`` instead of fitted ones: lets the summaries be checked by SQL."""
    return inputs.withColumn("cluster", F.pmod(F.col("customer_id"), F.lit(k)).cast("int"))


def _fixed_labels_a(spark: SparkSession, d: str) -> DataFrame:
    return fixed_clusters(_cluster_input_a(spark, d))


def _scaled_rounded(spark: SparkSession, d: str) -> DataFrame:
    z = profiles.scaled_features(_cluster_input_a(spark, d))
    return z.select("customer_id", *[F.round(c, 6).alias(c) for c in z.columns if c != "customer_id"])


def _fitted_a(spark: SparkSession, d: str) -> DataFrame:
    return exact_kmeans.fit_clusters(_cluster_input_a(spark, d))


def _kmeans_checks(spark: SparkSession, d: str) -> DataFrame:
    inputs = _cluster_input_a(spark, d)
    model, assembled = profiles.fit_kmeans(inputs)
    return profiles.kmeans_checks(inputs, model, model.transform(assembled))


def _item_texts() -> Column:
    """The items of an order as one text, in a fixed order, so that SQL can compare them."""

    def one(item: Column) -> Column:
        return F.concat_ws(":", item["name"], F.coalesce(item["discount"]["value"], F.lit("-")), item["quantity"])

    return F.when(F.col("items").isNotNull(), F.array_join(F.array_sort(F.transform("items", one)), "|"))


def _flat_times(rows: DataFrame) -> DataFrame:
    """Timestamps as wall-clock time, items as text."""
    times = {c: F.col(c).cast("timestamp_ntz") for c, kind in rows.dtypes if kind == "timestamp"}
    items = {"items": _item_texts()} if "items" in rows.columns else {}
    return rows.withColumns(times | items)


def _raw_layer(spark: SparkSession, d: str) -> tuple[str, str, str]:
    folder = f"{ensure_checkpoint_dir(spark)}/layers-{uuid.uuid4().hex}"
    return (folder, *tv.write_raw(spark, d, folder))


def _typed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Raw file to silver table and back."""
    folder, orders, _ = _raw_layer(spark, d)
    layers.silver_orders(spark, orders, f"{folder}/silver_orders")
    return _flat_times(readers.read_layer(spark, f"{folder}/silver_orders"))


def _typed_items(spark: SparkSession, d: str) -> DataFrame:
    """One row per item of the typed orders."""
    item = F.explode("items").alias("item")
    rows = silver_orders_a(spark, d).select("order_id", item)
    return rows.select("order_id", "item.name", F.col("item.discount.value").alias("discount"), "item.quantity")


def _malformed(spark: SparkSession, d: str) -> DataFrame:
    _, orders, _ = _raw_layer(spark, d)
    return quality.malformed_orders(readers.read_raw_orders(spark, orders, keep_corrupt=True))


def _silver_restaurant(spark: SparkSession, d: str) -> DataFrame:
    """S3: a dimension from CSV through silver."""
    folder, _, dimensions = _raw_layer(spark, d)
    layers.silver_dimension(spark, f"{dimensions}/restaurant.csv", schemas.RESTAURANT, f"{folder}/restaurant")
    return _flat_times(readers.read_layer(spark, f"{folder}/restaurant"))


def _gold_layer(spark: SparkSession, d: str) -> DataFrame:
    """Raw files to silver to the gold table and back, all 32 columns."""
    folder, orders, dimensions = _raw_layer(spark, d)
    layers.silver_orders(spark, orders, f"{folder}/orders_silver")
    kinds = {"consumer": schemas.CONSUMER, "ab_test_ref": schemas.AB_TEST_REF, "restaurant": schemas.RESTAURANT}
    for name, schema in kinds.items():
        layers.silver_dimension(spark, f"{dimensions}/{name}.csv", schema, f"{folder}/{name}")
    silver = [readers.read_layer(spark, f"{folder}/{name}") for name in ("orders_silver", *kinds)]
    layers.gold_abt(*silver, f"{folder}/gold")
    return _flat_times(layers.read_gold(spark, f"{folder}/gold"))


def _abt_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """J2 as for customer tables too large to broadcast: filtered, shuffled, hot keys salted."""
    abt = joins.build_abt(silver_orders_a(spark, d), *_dims(spark, d), hot_key_rows=20, broadcast_max_bytes=0)
    return _flat_times(abt)


def _views(spark: SparkSession, d: str) -> dict[str, str]:
    return sql_layers.register_views(dict(zip(sql_layers.TABLES, (silver_orders_a(spark, d), *_dims(spark, d)))))


def _sql_explore(spark: SparkSession, d: str) -> DataFrame:
    """J1 from SQL text over views of the layers."""
    return _flat_times(sql_layers.explore_join(spark, _views(spark, d)))


def _sql_abt(spark: SparkSession, d: str) -> DataFrame:
    """J2 from SQL text over views of the layers."""
    return _flat_times(sql_layers.build_abt(spark, _views(spark, d)))


def _sql_abt_period(spark: SparkSession, d: str) -> DataFrame:
    """The same for one quarter, by the parameters of the text."""
    period = {"since": datetime(1996, 1, 1), "until": datetime(1996, 4, 1)}
    return _flat_times(sql_layers.build_abt(spark, _views(spark, d), **period))


def _catalog_gold(spark: SparkSession, d: str) -> DataFrame:
    """S1-S7 through the catalog: silver tables and the gold table saved by name, joined by SQL text."""
    folder, orders, dimensions = _raw_layer(spark, d)
    database = f"campaign_{uuid.uuid4().hex}"
    spark.sql("CREATE DATABASE IDENTIFIER(:name) LOCATION :folder", args={"name": database, "folder": f"{folder}/catalog"})
    names = sql_layers.catalog_names(database)
    layers.silver_orders(spark, orders, names["orders"])
    kinds = {"consumer": schemas.CONSUMER, "ab_test_ref": schemas.AB_TEST_REF, "restaurant": schemas.RESTAURANT}
    for name, schema in kinds.items():
        layers.silver_dimension(spark, f"{dimensions}/{name}.csv", schema, names[name])
    write_layer(sql_layers.build_abt(spark, names), f"{database}.orders_gold")
    return _flat_times(layers.read_gold(spark, f"{database}.orders_gold"))


def _undeclared(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the raw records that the declared schema lacks."""
    _, orders, _ = _raw_layer(spark, d)
    return open_schema.undeclared_fields(spark, orders)


def _variant_items(spark: SparkSession, d: str) -> DataFrame:
    return open_schema.item_rows(open_schema.items_as_variant(tv.orders_a_raw(spark, d)))


def _typed_items_variant(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``typed_items`` from VARIANT."""
    text = {"name": "$.name", "discount": "$.discount.value", "quantity": "$.quantity"}
    return open_schema.item_values(_variant_items(spark, d), {c: (path, "string") for c, path in text.items()})


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """C1-C4 during S4: what the silver write itself counted."""
    folder, orders, _ = _raw_layer(spark, d)
    layers.silver_orders_observed(spark, orders, f"{folder}/silver", f"{folder}/silver_quality")
    return readers.read_layer(spark, f"{folder}/silver_quality")


#: The month that the rewrite queries run again.
REWRITTEN_MONTH = "1995-03"


def _gold_files(spark: SparkSession, path: str) -> DataFrame:
    return layers.read_gold(spark, path).select(layers.MONTH, F.input_file_name().alias("file")).distinct()


def _gold_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """S5 by month: all months written, one run again with corrected amounts, and whose files are new."""
    path = f"{ensure_checkpoint_dir(spark)}/gold-{uuid.uuid4().hex}"
    orders, dims = silver_orders_a(spark, d), _dims(spark, d)
    layers.gold_months(orders, *dims, path)
    before = _gold_files(spark, path).checkpoint(eager=True)
    corrected = orders.withColumn("order_total_amount", F.col("order_total_amount") * 2)
    layers.gold_months(corrected, *dims, path, months=[REWRITTEN_MONTH])
    spark.catalog.refreshByPath(path)
    same = _gold_files(spark, path).join(before, [layers.MONTH, "file"], "left_semi")
    same = same.select(F.col(layers.MONTH).alias("kept_month")).distinct()
    rows = layers.read_gold(spark, path).groupBy(layers.MONTH).agg(
        F.count(F.lit(1)).alias("row_count"), round2(exact_sum("order_total_amount")).alias("revenue")
    )
    # months: a short list
    joined = rows.join(F.broadcast(same), F.col(layers.MONTH) == F.col("kept_month"), "left")
    return joined.select(layers.MONTH, "row_count", "revenue", F.col("kept_month").isNull().alias("rewritten"))


def _stored_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/bitmaps-{uuid.uuid4().hex}"
    stored = distinct_bitmaps.bitmaps(abt_a(spark, d), layers.month_of())
    write_layer(stored, path, partition_by=[distinct_bitmaps.PERIOD])
    return readers.read_layer(spark, path)


def _bitmap_report(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return kpis.report_of(distinct_bitmaps.merged_metrics(_stored_bitmaps(spark, d)), name)

    return run


def _bitmap_months(spark: SparkSession, d: str) -> DataFrame:
    """Q4 of one quarter, from the bitmaps of its months."""
    metrics = distinct_bitmaps.merged_metrics(_stored_bitmaps(spark, d), ["1996-01", "1996-02", "1996-03"])
    return kpis.report_of(metrics, "group_kpis")


def _bitmap_viability(spark: SparkSession, d: str) -> DataFrame:
    return viability.compare_groups(distinct_bitmaps.merged_metrics(_stored_bitmaps(spark, d)))


def _streamed_latest(spark: SparkSession, d: str) -> DataFrame:
    """D3, W4 as a stream: files in three runs, one compacted between, one replayed."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = tv.orders_b_raw(spark, d).withColumn("order_created_at", F.date_format("order_created_at", TIME_TEXT))
    part = F.pmod(F.xxhash64("order_id", "customer_id"), F.lit(3))
    for run in range(3):
        rows = raw.filter(part == run)
        rows = rows.union(raw.filter(part == 0)) if run == 2 else rows  # the first files once more
        rows.write.mode("append").json(f"{folder}/raw")
        latest.stream_latest_orders(spark, f"{folder}/raw", f"{folder}/latest", f"{folder}/progress").awaitTermination()
        if run == 1:
            latest.compact(spark, f"{folder}/latest")
    return _flat_times(latest.read_latest_orders(spark, f"{folder}/latest").select(*raw.columns))


#: Timestamps as text with all their digits.
TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

QUERIES: dict[str, Query] = {
    # joins
    "exploratory_join": lambda s, d: _flat_times(explore_a(s, d)),
    "abt": lambda s, d: _flat_times(abt_a(s, d)),
    "abt_shuffled": _abt_shuffled,
    # layers and typing
    "typed_orders": _typed_orders,
    "typed_items": _typed_items,
    "silver_restaurant": _silver_restaurant,
    "gold_layer": _gold_layer,
    "quality_malformed": _malformed,
    "quality_observed": _observed,
    "undeclared_fields": _undeclared,
    "undeclared_item_fields": lambda s, d: open_schema.undeclared_item_fields(_variant_items(s, d)),
    "typed_items_variant": _typed_items_variant,
    "item_states": lambda s, d: open_schema.item_states(open_schema.items_as_variant(tv.orders_a_raw(s, d))),
    "sql_exploratory_join": _sql_explore,
    "sql_abt": _sql_abt,
    "sql_abt_period": _sql_abt_period,
    "catalog_gold": _catalog_gold,
    "gold_month_rewrite": _gold_rewrite,
    # A/B KPIs
    "group_order_share": lambda s, d: kpis.explore_report(explore_a(s, d), "group_order_share"),
    "group_revenue_share": lambda s, d: kpis.explore_report(explore_a(s, d), "group_revenue_share"),
    "group_summary_raw": lambda s, d: kpis.explore_report(explore_a(s, d), "group_summary_raw"),
    "group_kpis": lambda s, d: kpis.ab_report(abt_a(s, d), "group_kpis"),
    "group_customers": lambda s, d: kpis.ab_report(abt_a(s, d), "group_customers"),
    "group_summary_share": lambda s, d: kpis.ab_report(abt_a(s, d), "group_summary_share"),
    "orders_per_customer": lambda s, d: kpis.ab_report(abt_a(s, d), "orders_per_customer"),
    # O1, O2: the order of the sorted reports as a column
    "ordered_group_kpis": lambda s, d: with_positions(kpis.ab_report(abt_a(s, d), "group_kpis")),
    "ordered_daypart_report": lambda s, d: with_positions(segments.label_report(abt_b(s, d), segments.DAYPART)),
    "ordered_cluster_sizes": lambda s, d: with_positions(profiles.cluster_sizes(_fixed_labels_a(s, d))),
    "bitmap_group_kpis": _bitmap_report("group_kpis"),
    "bitmap_group_customers": _bitmap_report("group_customers"),
    "bitmap_group_summary_share": _bitmap_report("group_summary_share"),
    "bitmap_orders_per_customer": _bitmap_report("orders_per_customer"),
    "bitmap_quarter_kpis": _bitmap_months,
    "bitmap_campaign_viability": _bitmap_viability,
    "order_discounts": lambda s, d: kpis.order_discounts(silver_orders_a(s, d)),
    "order_discounts_strict": lambda s, d: kpis.order_discounts(silver_orders_a(s, d), strict_nulls=True),
    "total_discount": lambda s, d: kpis.total_discount(abt_a(s, d)),
    "total_discount_strict": lambda s, d: kpis.total_discount(abt_a(s, d), strict_nulls=True),
    "campaign_viability": lambda s, d: viability.campaign_viability(abt_a(s, d)),
    # segments (time of day and kind of day need every hour: orders_b)
    "customer_metrics": lambda s, d: segments.customer_metrics(abt_b(s, d)),
    "order_daypart": lambda s, d: segments.label_orders(abt_b(s, d), segments.DAYPART),
    "dominant_daypart": lambda s, d: segments.dominant_label(abt_b(s, d), segments.DAYPART),
    "daypart_report": lambda s, d: segments.label_report(abt_b(s, d), segments.DAYPART),
    "order_daytype": lambda s, d: segments.label_orders(abt_b(s, d), segments.DAY_TYPE),
    "dominant_daytype": lambda s, d: segments.dominant_label(abt_b(s, d), segments.DAY_TYPE),
    "top_merchant": lambda s, d: segments.dominant_value(abt_a(s, d), "merchant_id"),
    "top_city": lambda s, d: segments.dominant_value(abt_a(s, d), "merchant_city"),
    "daytype_report": lambda s, d: segments.label_report(abt_b(s, d), segments.DAY_TYPE),
    "customer_price_range": lambda s, d: segments.customer_price_tier(abt_a(s, d)).drop("price_tier"),
    "price_tier": lambda s, d: segments.customer_price_tier(abt_a(s, d)),
    "price_tier_report": lambda s, d: segments.price_tier_report(abt_a(s, d)),
    # data quality
    "quality_missing_consumer": lambda s, d: quality.missing_consumer(
        silver_orders_a(s, d), tv.ab_test_ref(s, d), tv.consumer(s, d)
    ),
    "quality_null_customer": lambda s, d: quality.null_customer(silver_orders_a(s, d)),
    "quality_repeated_orders": lambda s, d: quality.repeated_orders(silver_orders_b(s, d)),
    "quality_duplicate_keys": lambda s, d: quality.duplicate_keys(
        {
            "consumer": (tv.consumer(s, d), "customer_id"),
            "ab_test_ref": (tv.ab_test_ref(s, d), "customer_id"),
            "restaurant": (tv.restaurant(s, d), "id"),
        }
    ),
    "streamed_latest_order": _streamed_latest,
    "latest_order": lambda s, d: ingest.keep_latest_order(silver_orders_b(s, d)),
    # customer profiles.  The cluster summaries run on the labels customer_id mod 4 (every
    # clustered customer kept); the fitted_* entries and customer_clusters run on the labels of
    # the exact k-means; kmeans_checks on a fit of Spark ML's.
    "customer_features": lambda s, d: profiles.customer_features(abt_a(s, d)),
    "cluster_input": _cluster_input_a,
    "scaled_features": _scaled_rounded,
    "customer_clusters": _fitted_a,
    "cluster_centres": lambda s, d: exact_kmeans.cluster_centres(_cluster_input_a(s, d)),
    "kmeans_checks": _kmeans_checks,
    "cluster_means": lambda s, d: profiles.cluster_means(_fixed_labels_a(s, d)),
    "cluster_sizes": lambda s, d: profiles.cluster_sizes(_fixed_labels_a(s, d)),
    "cluster_profiles": lambda s, d: profiles.cluster_profiles(_fixed_labels_a(s, d)),
    "profile_means": lambda s, d: profiles.profile_means(_fixed_labels_a(s, d)),
    "profile_shares": lambda s, d: profiles.profile_shares(_fixed_labels_a(s, d)),
    "customer_groups": lambda s, d: profiles.customer_group(abt_a(s, d)),
    "customer_group": lambda s, d: profiles.clustered_group_counts(_cluster_input_a(s, d)),
    "profile_group_summary": lambda s, d: profiles.profile_group_summary(_fixed_labels_a(s, d)),
    # the summaries on fitted clusters
    "fitted_cluster_means": lambda s, d: profiles.cluster_means(_fitted_a(s, d)),
    "fitted_cluster_profiles": lambda s, d: profiles.cluster_profiles(_fitted_a(s, d)),
    "fitted_profile_shares": lambda s, d: profiles.profile_shares(_fitted_a(s, d)),
    "fitted_profile_group_summary": lambda s, d: profiles.profile_group_summary(_fitted_a(s, d)),
}
