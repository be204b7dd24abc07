"""Sources and sinks: raw JSON, dimension CSV, silver and gold layer round trips."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from campaign_analytics import schemas
from campaign_analytics.operators import joins
from campaign_analytics.plans import layers
from campaign_analytics.sources import readers, writers


def _key(r):
    return tuple("" if v is None else str(v) for v in r)


@pytest.fixture()
def raw_orders_dir(spark, scratch_dir):
    items = json.dumps([{"name": "a", "discount": {"value": "2.50", "currency": "BRL"}}])
    rows = [
        {"order_id": "o1", "customer_id": "c1", "merchant_id": "m1", "order_total_amount": 30.5,
         "order_created_at": "2019-01-05T12:30:00Z", "order_scheduled": False, "items": items,
         "merchant_latitude": "-23.5571", "unknown_field": "ignored"},
        {"order_id": "o2", "customer_id": "c2", "merchant_id": "m2", "order_total_amount": 12.0,
         "order_created_at": "2019-01-06T20:00:00Z", "order_scheduled": True, "items": "[]"},
        {"order_id": "o2", "customer_id": "c2", "merchant_id": "m2", "order_total_amount": 12.0,
         "order_created_at": "2018-01-06T20:00:00Z", "order_scheduled": True, "items": "[]"},
        {"order_id": "o3", "customer_id": None, "order_total_amount": 7.0},
    ]
    path = os.path.join(scratch_dir, "bronze")
    os.makedirs(path)
    import gzip

    with gzip.open(os.path.join(path, "part-0.json.gz"), "wt") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")
    return path


def _write_csv(path, header, rows):
    os.makedirs(path)
    with open(os.path.join(path, "part-0.csv"), "w") as fh:
        fh.write(",".join(header) + "\n")
        for r in rows:
            fh.write(",".join("" if v is None else str(v) for v in r) + "\n")


def test_read_raw_orders_declared_schema(spark, raw_orders_dir):
    df = readers.read_raw_orders(spark, raw_orders_dir, partitions=4)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.ORDER_RAW]
    assert df.rdd.getNumPartitions() == 4
    assert df.count() == 4
    assert sorted(r.order_id for r in df.collect()) == ["o1", "o2", "o2", "o3"]


def test_read_dimension_csv_types_by_name(spark, scratch_dir):
    path = os.path.join(scratch_dir, "restaurant")
    header = ["merchant_state", "id", "extra", "price_range", "enabled", "created_at", "average_ticket",
              "delivery_time", "minimum_order_value", "merchant_city"]
    _write_csv(path, header, [["SP", "m1", "z", "2", "true", "2017-01-01T10:00:00Z", "55.5", "40", "15.0", "Sao Paulo"],
                              ["RJ", "m2", "z", "x", "false", "", "", "", "", ""]])
    df = readers.read_dimension_csv(spark, path, schemas.RESTAURANT)
    assert df.columns == [f.name for f in schemas.RESTAURANT]
    got = {r.id: r for r in df.collect()}
    assert got["m1"].price_range == 2 and got["m1"].enabled is True and got["m1"].average_ticket == 55.5
    assert got["m1"].created_at.year == 2017
    assert got["m2"].price_range is None and got["m2"].enabled is False

    with pytest.raises(ValueError):
        readers.read_dimension_csv(spark, path, schemas.CONSUMER)


def test_layers_round_trip(spark, raw_orders_dir, scratch_dir):
    silver = os.path.join(scratch_dir, "silver")
    layers.silver_orders(spark, raw_orders_dir, silver, partitions=2)
    s = readers.read_layer(spark, silver)
    assert s.count() == 4
    assert dict(s.dtypes)["order_created_at"] == "timestamp"
    assert s.filter("order_id = 'o1'").first().merchant_latitude == -23.56

    deduped = os.path.join(scratch_dir, "silver_latest")
    layers.silver_orders(spark, raw_orders_dir, deduped, partitions=2, keep_latest=True)
    d = readers.read_layer(spark, deduped)
    assert d.count() == 3
    assert d.filter("order_id = 'o2'").first().order_created_at.year == 2019

    consumer = spark.createDataFrame([("c1", None, True)], schemas.CONSUMER)
    ab = spark.createDataFrame([("c1", "target"), ("c2", "control")], schemas.AB_TEST_REF)
    rest = spark.createDataFrame([("m1", None, True, 3, 40.0, 30, 10.0, "x", "y")], schemas.RESTAURANT)
    gold = os.path.join(scratch_dir, "gold")
    layers.gold_abt(s, consumer, ab, rest, gold)
    g = layers.read_gold(spark, gold)
    expected = joins.build_abt(s, consumer, ab, rest)
    assert g.columns == expected.columns
    cols = [c for c in g.columns if c != "items"]
    assert sorted(g.select(*cols).collect(), key=_key) == sorted(expected.select(*cols).collect(), key=_key)
    assert g.count() == 3
    assert g.filter("order_id = 'o1'").first().merchant_price_range == 3


def test_write_layer_to_catalog_table(spark):
    df = spark.range(5).select(F.col("id").alias("customer_id"))
    writers.write_layer(df, "campaign_test_table")
    assert readers.read_layer(spark, "campaign_test_table").count() == 5
    spark.sql("DROP TABLE campaign_test_table")


def test_rows_do_not_depend_on_the_read_tasks(spark, scratch_dir):
    """Two plain records, a blank line, white space, an array line of two records, a broken line."""
    path = os.path.join(scratch_dir, "mixed.json")
    lines = ['{"order_id": "1", "order_total_amount": "7.25"}', "", "   ", '[{"order_id": "2"}, {"order_id": "3"}]',
             '{"order_id": "4", "order_total_amount": 1.5}', '{"order_id": "5"']
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    for partitions in (1, 16):
        rows = readers.read_raw_orders(spark, path, partitions=partitions, keep_corrupt=True).collect()
        assert sorted(r.order_id or "" for r in rows) == ["", "1", "2", "3", "4"], partitions
        assert [r._corrupt_record for r in rows if r.order_id is None] == ['{"order_id": "5"']
        amounts = {r.order_id: r.order_total_amount for r in rows}
        assert amounts["1"] == "7.25" and amounts["4"] == "1.5"


def test_whole_numbers_with_a_point_survive(spark, scratch_dir):
    path = os.path.join(scratch_dir, "numbers")
    header = [f.name for f in schemas.RESTAURANT]
    values = {"id": "m1", "price_range": "3.0", "delivery_time": "45.5", "minimum_order_value": "10"}
    _write_csv(path, header, [[values.get(h) for h in header]])
    row = readers.read_dimension_csv(spark, path, schemas.RESTAURANT).first()
    assert row.price_range == 3 and row.delivery_time is None and row.minimum_order_value == 10.0
