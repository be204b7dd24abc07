"""Hot keys: a customer with a third of all orders, and many NULL customers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from campaign_analytics.operators import joins
from campaign_analytics.plans import registry
from conftest import SF_SMALL


@pytest.fixture()
def shuffled_joins(spark):
    """Force shuffled joins without partition coalescing, so the split is visible."""
    keys = [
        "spark.sql.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.coalescePartitions.enabled",
    ]
    old = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def skewed_fact(spark, n=3000):
    idx = F.col("id")
    customer = (
        F.when(idx % 3 == 0, F.lit("hot"))
        .when(idx % 10 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("c"), (idx % 50).cast("string")))
    )
    return spark.range(n).select(
        idx.cast("string").alias("order_id"),
        customer.alias("customer_id"),
        (idx % 97).cast("double").alias("amount"),
    )


def customer_dim(spark):
    rows = [("hot", "target")] + [(f"c{i}", "control" if i % 2 else "target") for i in range(50)]
    return spark.createDataFrame(rows, "customer_id string, ab_group string")


def _hot(fact, rows):
    return {r[0]: r[1] for r in joins.hot_keys(fact, "customer_id", hot_key_rows=rows).collect()}


def test_hot_keys_finds_hot_customer_and_null(spark):
    # 1000 rows / 100 per bucket, and 200 rows without a customer
    assert _hot(skewed_fact(spark), 100) == {"hot": 10, None: 2}


def test_hot_keys_empty_when_table_is_small(spark):
    assert _hot(skewed_fact(spark), 10_000) == {}


def test_every_one_of_many_hot_keys_is_found(spark):
    fact = spark.range(3000 * 30).select((F.col("id") % 3000).alias("customer_id"))
    assert len(_hot(fact, 20)) == 3000


def test_hot_keys_under_a_long_tail_are_found(spark):
    tail = spark.range(200_000).select((F.col("id") + 1000).alias("customer_id"))
    hot = spark.range(200 * 100).select((F.col("id") % 200).alias("customer_id"))
    assert _hot(tail.union(hot), 20) == {i: 5 for i in range(200)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_plain_join(spark, shuffled_joins, how):
    fact, dim = skewed_fact(spark), customer_dim(spark)
    salted = joins.skew_join(fact, dim, "customer_id", how, hot_key_rows=100)
    plain = fact.join(dim, "customer_id", how)
    assert salted.columns == plain.columns
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(salted.collect(), key=key) == sorted(plain.collect(), key=key)


def test_skew_join_spreads_the_hot_key(spark, shuffled_joins):
    fact, dim = skewed_fact(spark), customer_dim(spark)
    salted = joins.skew_join(fact, dim, "customer_id", "inner", hot_key_rows=100)
    per_task = (
        salted.filter(F.col("customer_id") == "hot")
        .groupBy(F.spark_partition_id().alias("p"))
        .count()
        .collect()
    )
    assert len(per_task) > 1
    assert max(r["count"] for r in per_task) < 1000
    plain = fact.join(dim, "customer_id", "inner").filter(F.col("customer_id") == "hot")
    assert plain.groupBy(F.spark_partition_id()).count().count() == 1


def test_skew_join_with_duplicate_dimension_key(spark, shuffled_joins):
    fact = skewed_fact(spark)
    dim = customer_dim(spark).unionByName(spark.createDataFrame([("hot", "control")], "customer_id string, ab_group string"))
    salted = joins.skew_join(fact, dim, "customer_id", "inner", hot_key_rows=100)
    assert salted.filter(F.col("customer_id") == "hot").count() == 2000
    assert salted.count() == fact.join(dim, "customer_id", "inner").count()


def test_abt_with_hot_customer_equals_small_threshold(spark):
    from conftest import SF_SMALL

    from campaign_analytics.plans import registry
    from campaign_analytics.sources import testviews as tv

    orders = registry.silver_orders_a(spark, SF_SMALL)
    dims = (tv.consumer(spark, SF_SMALL), tv.ab_test_ref(spark, SF_SMALL), tv.restaurant(spark, SF_SMALL))
    broadcast = joins.build_abt(orders, *dims).drop("items")
    salted = joins.build_abt(orders, *dims, hot_key_rows=5, broadcast_max_bytes=0).drop("items")
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(broadcast.collect(), key=key) == sorted(salted.collect(), key=key)
    x_broadcast = joins.explore_join(orders, *dims).drop("items")
    x_salted = joins.explore_join(orders, *dims, hot_key_rows=5, broadcast_max_bytes=0).drop("items")
    assert sorted(x_broadcast.collect(), key=key) == sorted(x_salted.collect(), key=key)


def test_measured_sizes_and_broadcast_decision(spark):
    df = spark.createDataFrame([("abc", 1.0), ("de", None), (None, 2.0)], "k string, v double")
    # 3 rows x (8 for the double, 8 per column, the row's overhead) and 5 string bytes
    size = 3 * (8 + 16 + joins.BROADCAST_ROW_OVERHEAD) + 5
    assert joins.measured_sizes({"df": df}) == {"df": size}
    # the bound is on the sum: of two that fit alone, one is chosen
    assert joins.broadcast_set({"a": df}, size) == {"a"}
    assert len(joins.broadcast_set({"a": df, "b": df}, size)) == 1
    assert joins.broadcast_set({"a": df, "b": df}, 2 * size) == {"a", "b"}
    assert joins.broadcast_set({"a": df}, size - 1) == set()


def test_a_dimension_far_over_the_bound_is_not_measured(spark, monkeypatch):
    large = spark.range(1_000_000)
    monkeypatch.setattr(joins, "measured_sizes", lambda frames: {n: 1 for n in frames} if not frames else 1 / 0)
    assert joins.estimated_bytes(large) == 8_000_000
    assert joins.broadcast_set({"large": large}, 100) == set()


def test_a_missing_dimension_column_is_an_error(spark):
    with pytest.raises(ValueError, match="is_target"):
        joins.ab_dim(spark.createDataFrame([("a", "b")], "customer_id string, group string"))


def test_small_dimensions_are_broadcast_in_the_abt_plan(spark):
    from conftest import SF_SMALL

    from campaign_analytics.plans import registry

    plan = registry.abt_a(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_abt_without_merchants_on_shuffled_path(spark):
    from conftest import SF_SMALL

    from campaign_analytics.plans import registry
    from campaign_analytics.sources import testviews as tv

    orders = registry.silver_orders_b(spark, SF_SMALL)
    dims = (tv.consumer(spark, SF_SMALL), tv.ab_test_ref(spark, SF_SMALL), tv.restaurant(spark, SF_SMALL))
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    for build in (joins.build_abt, joins.explore_join):
        broadcast = build(orders, *dims)
        shuffled = build(orders, *dims, hot_key_rows=3, broadcast_max_bytes=0)
        assert broadcast.columns == shuffled.columns
        assert sorted(broadcast.collect(), key=key) == sorted(shuffled.collect(), key=key)


def test_hot_customer_with_a_third_of_real_orders_is_spread(spark, shuffled_joins):
    from conftest import SF_CHECK

    from campaign_analytics.plans import registry
    from campaign_analytics.sources import testviews as tv

    orders = registry.silver_orders_a(spark, SF_CHECK).withColumn(
        "customer_id", F.when(F.col("order_id") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("customer_id"))
    )
    customers = joins.ab_dim(tv.ab_test_ref(spark, SF_CHECK))
    total = orders.filter(F.col("customer_id").isNotNull()).join(customers, "customer_id").count()

    def largest_task(df):
        return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

    plain = orders.join(customers, "customer_id", "inner")
    salted = joins.skew_join(orders, customers, "customer_id", "inner", hot_key_rows=500)
    assert salted.count() == plain.count() == total
    assert largest_task(plain) >= total / 3
    assert largest_task(salted) < total / 5


def test_filter_of_join_keys_keeps_every_partner(spark):
    keys = spark.range(0, 3000, 3).select((F.col("id") * 7).cast("string").alias("customer_id"))
    keys = keys.union(spark.createDataFrame([(None,)], "customer_id string"))
    fact = spark.range(20_000).select(F.col("id").cast("string").alias("customer_id"), F.col("id").alias("_words"))
    kept = joins.reduced_fact(fact, keys, "customer_id")
    partners = fact.join(keys, "customer_id", "left_semi")
    assert kept.columns == fact.columns
    assert partners.join(kept, ["customer_id", "_words"], "left_anti").isEmpty() and partners.count() == 953
    assert kept.count() < partners.count() + 0.05 * fact.count()
    assert joins.reduced_fact(fact, keys, "customer_id", max_bytes=100) is fact
    assert joins.reduced_fact(fact, keys.limit(0), "customer_id").count() == 0
    assert joins.reduced_fact(fact.limit(0), keys, "customer_id").count() == 0


def test_filter_does_not_change_the_abt(spark):
    orders = registry.silver_orders_a(spark, SF_SMALL)
    dims = registry._dims(spark, SF_SMALL)
    with_, without = (
        joins.build_abt(orders, *dims, hot_key_rows=50, broadcast_max_bytes=0, filter_max_bytes=b) for b in (1 << 30, 0)
    )
    cols = [c for c in without.columns if c != "items"]
    assert with_.select(cols).exceptAll(without.select(cols)).isEmpty() and with_.count() == without.count()
