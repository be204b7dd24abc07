"""Rows the test tables lack: odd raw records and items, months, bitmaps, open labels, the exact k-means."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from campaign_analytics.functions.expressions import exact_avg
from campaign_analytics.operators import distinct_bitmaps, exact_kmeans, group_metrics, open_schema, profiles, quality, segments
from campaign_analytics.plans import layers, registry, sql_layers
from campaign_analytics.session import ensure_checkpoint_dir
from campaign_analytics.sources import readers
from campaign_analytics.sources import testviews as tv
from campaign_analytics.streaming import latest
from conftest import SF_SMALL


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def write_lines(folder, *lines):
    os.makedirs(folder)
    with open(f"{folder}/part.json", "w") as f:
        f.write("\n".join(lines))
    return folder


def test_undeclared_fields_of_odd_lines(spark, scratch_dir):
    raw = write_lines(
        f"{scratch_dir}/raw",
        '{"order_id": "1", "gift": 1, "note": null}',
        '[{"order_id": "2", "gift": 2.5}, {"gift": "x", "order_id": "3"}, 7]',
        "",
        '{"order_id": "4", "gift"',
        '"text"',
        "[]",
        "{}",
        '{"a.b": {"c": 1}}',
    )
    found = {r.field_name: (r.value_count, r.value_type) for r in open_schema.undeclared_fields(spark, raw).collect()}
    assert found == {"gift": (3, "VARIANT"), "note": (1, "VOID"), "a.b": (1, "OBJECT<c: BIGINT>")}
    empty = write_lines(f"{scratch_dir}/empty")
    assert open_schema.undeclared_fields(spark, empty).collect() == []


def test_item_states(spark):
    given = [
        ("1", '[{"name": "a", "size": 3}, {"name": "b", "discount": {"value": "2"}}]'),
        ("2", None), ("3", " "), ("4", "[{"), ("5", "{}"), ("6", "[]"), ("7", "[1, null]"),
    ]
    orders = open_schema.items_as_variant(spark.createDataFrame(given, "order_id string, items string"))
    states = {r.order_id: r.items_state for r in orders.collect()}
    assert states == {
        "1": "items", "2": "absent", "3": "absent", "4": "malformed", "5": "not_a_list", "6": "empty", "7": "items",
    }
    assert rows(open_schema.item_states(orders)) == [
        ("absent", 2, 0), ("empty", 1, 0), ("items", 2, 4), ("malformed", 1, 0), ("not_a_list", 1, 0),
    ]
    items = open_schema.item_rows(orders)
    assert rows(open_schema.undeclared_item_fields(items)) == [("size", 1, "BIGINT")]
    values = open_schema.item_values(items, {"name": ("$.name", "string"), "off": ("$.discount.value", "double")})
    assert rows(values) == [("1", "a", None), ("1", "b", 2.0), ("7", None, None), ("7", None, None)]


def test_observed_counts_equal_a_second_scan(spark, scratch_dir):
    raw = write_lines(
        f"{scratch_dir}/raw",
        '{"order_id": "1", "customer_id": "7", "order_total_amount": "1.5", "order_created_at": "2020-01-01 00:00:00"}',
        '{"order_id": "2", "order_total_amount": "1e30", "order_scheduled": "perhaps"}',
        '{"order_id": "3", "customer_id": "8", "order_total_amount": "x", "items": "[}"}',
        '{"order_id":',
    )
    seen = Observation()
    given = readers.read_raw_orders(spark, raw, keep_corrupt=True)
    quality.type_observed(given, seen).write.parquet(f"{scratch_dir}/silver")
    observed = rows(quality.observed_rows(spark, seen.get))
    assert [r for r in observed if r[0] != "customer_id"] == rows(quality.malformed_orders(given))
    assert ("customer_id", 4, 2) in observed and ("order_total_amount", 3, 2) in observed
    assert spark.read.parquet(f"{scratch_dir}/silver").count() == 4


def test_average_divides_by_the_amounts_summed(spark):
    odd = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 1e30), ("a", None), ("b", None)], "ab_group string, order_total_amount double")
    found = odd.groupBy("ab_group").agg(exact_avg("order_total_amount").alias("mean"))
    assert rows(found) == [("a", 1.0), ("b", None)]
    metrics = group_metrics.group_metrics(odd.withColumn("order_id", F.lit(1)))
    assert {r.ab_group: r.amount_rows for r in metrics.collect()} == {"a": 1, "b": 0}


def _files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_month_rerun_touches_its_folder_alone(spark, scratch_dir):
    orders = registry.silver_orders_a(spark, SF_SMALL).limit(400).checkpoint()
    dims = registry._dims(spark, SF_SMALL)
    gold = f"{scratch_dir}/gold"
    layers.gold_months(orders, *dims, gold)
    count = {r[0]: r[1] for r in layers.read_gold(spark, gold).groupBy(layers.MONTH).count().collect()}
    month, other = sorted(m for m in count if m != layers.NO_MONTH)[:2]
    before = _files(gold)
    kept = orders.filter(layers.month_of() != month)
    layers.gold_months(kept, *dims, gold, months=[month])  # its orders are gone
    changed = {f for f in before ^ _files(gold)}
    assert changed and all(f"{layers.MONTH}={month}/" in f for f in changed)
    assert layers.read_gold(spark, gold, [month]).count() == 0
    layers.gold_months(orders, *dims, gold, months=[month])
    again = {r[0]: r[1] for r in layers.read_gold(spark, gold).groupBy(layers.MONTH).count().collect()}
    assert again == count
    plan = layers.read_gold(spark, gold, [other])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and other in plan.split("PartitionFilters:")[1].split("\n")[0]


def test_bitmaps_of_text_ids_and_of_a_later_month(spark, scratch_dir):
    given = [("t", "1", "a", f"o{i}", float(i)) for i in range(40_000)] + [("t", "2", "b", "o1", 1.0), ("t", "2", None, None, None)]
    given += [(None, "2", "a", "o1", 2.0), ("c", "3", None, None, 5.0)]
    orders = spark.createDataFrame(given, "ab_group string, month string, customer_id string, order_id string, order_total_amount double")
    numbered = orders
    for column in ("order_id", "customer_id"):
        numbers = distinct_bitmaps.number_ids(orders, column, f"{scratch_dir}/{column}")
        numbered = distinct_bitmaps.with_numbers(numbered, column, numbers)
    stored = distinct_bitmaps.bitmaps(numbered, F.col("month"))
    for months in (None, ["1"], ["2", "3"], ["9"]):
        kept = orders if months is None else orders.filter(F.col("month").isin(months))
        plain = group_metrics.group_metrics(kept)
        merged = distinct_bitmaps.merged_metrics(stored, months).na.fill(0, ["order_count", "customer_count"])
        assert rows(merged.select(*plain.columns)) == rows(plain)


def test_dominant_value(spark):
    given = [(1, "b"), (1, "a"), (1, "b"), (2, "z"), (2, "y"), (3, None), (None, "a")]
    frame = spark.createDataFrame(given, "customer_id int, place string")
    assert rows(segments.dominant_value(frame, "place")) == [(1, "b", 2), (2, "y", 1)]


def test_sql_takes_values_not_text(spark):
    orders, dims = registry.silver_orders_a(spark, SF_SMALL), registry._dims(spark, SF_SMALL)
    names = sql_layers.register_views(dict(zip(sql_layers.TABLES, (orders, *dims))))
    text = "SELECT count(*) AS n FROM IDENTIFIER(:orders) WHERE CAST(merchant_id AS STRING) = :merchant"
    found = sql_layers.query(spark, text, {"orders": names["orders"]}, merchant="1 OR true")
    assert found.first()["n"] == 0
    plan = sql_layers.build_abt(spark, names)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull" in plan or "isnotnull" in plan


def _customers(spark, given):
    schema = "customer_id int, order_count long, revenue double, avg_ticket double, avg_days_between_orders double, ab_group string"
    return spark.createDataFrame(given, schema)


def test_exact_kmeans(spark):
    given = [(i, 1 + i % 3, 10.0 * (i % 7), 5.0 + i % 2, float(i % 5), "t") for i in range(60)]
    inputs = _customers(spark, given)
    first = rows(exact_kmeans.fit_clusters(inputs))
    assert first == rows(exact_kmeans.fit_clusters(inputs.repartition(7, "revenue")))
    fit, points = exact_kmeans.fit_exact(inputs)
    assert fit.settled and len(fit.centres) == 4
    label = {r[0]: r[-1] for r in first}
    for r in points.collect():
        p = [r[c] for c in exact_kmeans.POINT]
        away = [sum((a - b) ** 2 for a, b in zip(p, c)) for c in fit.centres]
        assert label[r["customer_id"]] == away.index(min(away))
    assert sum(r["customer_count"] for r in exact_kmeans.cluster_centres(inputs).collect()) == 60


def test_exact_kmeans_of_few_customers(spark):
    same = _customers(spark, [(i, 2, 1.0, 1.0, 1.0, None) for i in range(3)])
    assert [r[-1] for r in rows(exact_kmeans.fit_clusters(same))] == [0, 0, 0]
    none = same.limit(0)
    assert exact_kmeans.fit_clusters(none).collect() == [] and exact_kmeans.cluster_centres(none).collect() == []
    assert profiles.profile_shares(exact_kmeans.fit_clusters(none)).collect() == []


def test_exact_kmeans_is_no_worse_than_a_fit_of_random_starts(spark):
    inputs = registry._cluster_input_a(spark, SF_SMALL).checkpoint()
    exact = sum(r["inertia"] for r in exact_kmeans.cluster_centres(inputs).collect()) / exact_kmeans.GRID**2
    model, _ = profiles.fit_kmeans(inputs)
    assert exact < 1.15 * model.summary.trainingCost


def test_latest_orders_survive_replays_and_lost_compactions(spark, scratch_dir):
    schema = "order_id string, order_created_at timestamp, customer_id string"
    first = spark.sql("SELECT '1' AS order_id, timestamp'2020-01-02' AS order_created_at, 'a' AS customer_id "
                      "UNION ALL SELECT '2', timestamp'2020-01-01', 'b'")
    second = spark.sql("SELECT '1', timestamp'2020-01-01', 'c' UNION ALL SELECT '2', timestamp'2020-01-03', 'd'").toDF(*first.columns)
    assert first.schema.names == [c.split()[0] for c in schema.split(", ")]
    table = f"{scratch_dir}/latest"
    assert latest.read_latest_orders(spark, table) is None
    write = latest.write_batch(table)
    write(first, 0)
    write(first, 0)
    write(second, 1)
    expected = [("1", "a"), ("2", "d")]
    read = lambda: rows(latest.read_latest_orders(spark, table).select("order_id", "customer_id"))
    assert read() == expected
    os.makedirs(f"{table}/base/upto_000000000001")  # a compaction that did not end
    assert read() == expected
    latest.compact(spark, table)
    write(first, 2)
    write(second, 1)  # a replay of what the base holds already
    assert read() == expected


def test_checkpoint_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_views_have_their_own_names(spark):
    frame = tv.consumer(spark, SF_SMALL)
    one, two = (sql_layers.register_views({"consumer": frame}) for _ in range(2))
    assert one != two
