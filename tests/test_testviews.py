"""The order model's views over rows of their own."""

from __future__ import annotations

import json
from datetime import datetime

from campaign_analytics.sources import testviews as tv

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
LINES += "l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"
ORDERS = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def write_rows(spark, folder):
    lines = [
        (1, 45, 3, 1, 2.0, 10.0, 0.123, "A", "F"),
        (1, 45, 3, 1, 2.0, 10.0, 0.123, "A", "F"),
        (1, None, 2, 2, None, 7.0, None, None, "O"),
        (4, 27, 5, 3, 1.5, 1.0, 0.5, None, "O"),
        (9, 7, None, 4, 1.0, 100.0, 0.05, "R", None),
        (None, 8, 1, 1, 1.0, 1.0, 0.1, "R", "F"),
    ]
    orders = [(k, 1, 5.0, datetime(1996, 1, 2), "1-URGENT") for k in (1, 4, 9, 10, None)]
    spark.createDataFrame(lines, LINES).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def item(name, value, quantity, **more):
    found = {"name": name, "discount": {"value": value, "currency": "BRL"}, "quantity": quantity, **more}
    found["discount"] = {k: v for k, v in found["discount"].items() if v is not None}
    return {k: v for k, v in found.items() if v is not None}


def test_items_of_orders(spark, tmp_path):
    rows = tv.orders_a_raw(spark, write_rows(spark, tmp_path)).collect()
    found = {r["order_id"]: (r["merchant_id"], r["items"]) for r in rows}
    twice = item("45", "1.23", "2.0", line=1, tags=["A", "F"])
    as_text = lambda items: sorted(json.dumps(x, sort_keys=True) for x in items)
    expected = {
        1: (2, [twice, twice, item(None, None, None)]),
        4: (5, [item("27", None, "1.5", tags=[None, "O"])]),
        9: (None, [item("7", "5.0", "1.0")]),
    }
    assert found.keys() == {1, 4, 9, 10, None} and found[10] == found[None] == (None, None)
    for key, (merchant, items) in expected.items():
        assert found[key][0] == merchant
        assert as_text(json.loads(found[key][1])) == as_text(items)


def test_lines_are_shuffled_before_they_are_lists(spark, tmp_path):
    """Lists of items made before the shuffle sort all lines, and move wider rows than the lines are."""
    plan = tv.orders_a_raw(spark, write_rows(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    _, below = plan.split("Exchange hashpartitioning(l_orderkey", 1)
    assert "collect_list" in plan and "collect_list" not in below
