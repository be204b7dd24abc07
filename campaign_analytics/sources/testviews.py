"""The driver's generic test tables mapped onto the order model.

The campaign data itself is not available, so the order model is derived from the
TPC-H-like tables in ``/root/testdata``.  The same definitions, written in DuckDB SQL,
are the ``MODEL`` of :mod:`campaign_analytics.plans.oracle`; both follow ``FIXTURES.md``
section 2.  Every row of every table is used: unmatched keys are made on the order side (some
orders name a customer or merchant that no table has) and by extra rows of the A/B table
that the customer table lacks.

``orders_a`` (from ``orders`` + ``lineitem``) has merchants, item JSON, null customers and
orders without items; ``orders_b`` (from ``events``) has every hour of the day and
duplicate order ids belonging to two customers.  ``order_texts`` holds the complete raw
record of every order as text, some of it malformed, for the layers' files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import CONTROL, TARGET
from ..schemas import AB_TEST_REF, CONSUMER, ORDER_RAW, RESTAURANT

#: Added to an id to name one that the dimension tables do not have.
UNKNOWN = 10_000_000
THIRD_LABEL = "variant_b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _days_after_2020(days: Column) -> Column:
    return F.lit("2020-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days.cast("int"))


def ab_test_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    ids = table(spark, sf_dir, "customer").select(key)
    more = ids.filter(key % 50 == 7).select((key + UNKNOWN).alias("c_custkey"))
    label = F.when(key % 11 == 5, THIRD_LABEL).when(key % 2 == 0, TARGET).otherwise(CONTROL)
    return ids.union(more).select(key.alias("customer_id"), label.alias("is_target"))


def consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        _days_after_2020(F.col("c_custkey") % 1000).alias("created_at"),
        (F.col("c_acctbal") >= 0).alias("active"),
    )


def restaurant(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            key.alias("id"),
            _days_after_2020(key % 500).alias("created_at"),
            (F.col("s_acctbal") >= 0).alias("enabled"),
            (F.lit(1) + key % 3).cast("int").alias("price_range"),
            F.col("s_acctbal").alias("average_ticket"),
            F.when(key % 8 > 0, key % 90).cast("int").alias("delivery_time"),
            (key % 40).cast("double").alias("minimum_order_value"),
            F.col("n_name").alias("merchant_city"),
            F.col("r_name").alias("merchant_state"),
        )
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: its merchant, and its items as JSON text, some without a discount, some with
    fields that the item schema lacks.

    Grouping line items per order is bounded by the number of lines an order has
    (at most seven in TPC-H), so the per-order list is small.  The lines are shuffled by order
    as they are, without what the items leave out, and become items after that: lists made
    before the shuffle would sort every line first and move wider rows.
    """
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    discount = F.round(F.col("l_extendedprice") * F.col("l_discount"), 2)
    tagged = part % 9 == 0
    lines = table(spark, sf_dir, "lineitem").select(
        key,
        F.col("l_suppkey"),
        part,
        F.when((key + part) % 31 != 0, discount).alias("discount"),
        F.col("l_quantity"),
        F.when(part % 5 == 0, F.col("l_linenumber")).alias("line"),
        F.when(tagged, F.col("l_returnflag")).alias("returnflag"),
        F.when(tagged, F.col("l_linestatus")).alias("linestatus"),
    )
    item = F.struct(
        part.cast("string").alias("name"),
        F.struct(F.col("discount").cast("string").alias("value"), F.lit("BRL").alias("currency")).alias("discount"),
        F.col("l_quantity").cast("string").alias("quantity"),
        F.col("line"),
        F.when(tagged, F.array("returnflag", "linestatus")).alias("tags"),
    )
    merchant = F.min("l_suppkey")
    return lines.repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.when(key % 10 == 9, merchant + UNKNOWN).otherwise(merchant).alias("merchant_id"),
        F.to_json(F.collect_list(item)).alias("items"),
    )


def orders_a_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw orders with ``items`` as JSON text, one item per line item of the order."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    return o.join(_items(spark, sf_dir), key == F.col("l_orderkey"), "left").select(
        key.alias("order_id"),
        F.when(key % 400 == 0, F.lit(None))
        .when(key % 50 == 7, customer + UNKNOWN)
        .otherwise(customer)
        .alias("customer_id"),
        F.col("merchant_id"),
        F.round(F.col("o_totalprice") + (key % 7) * F.lit(0.001), 3).alias("order_total_amount"),
        F.col("o_orderdate").alias("order_created_at"),
        (F.col("o_orderpriority") == "1-URGENT").alias("order_scheduled"),
        F.col("items"),
    )


def orders_b_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    customer = F.col("user_id") * 10 + F.get_json_object("props", "$.k").cast("int") % 10
    return table(spark, sf_dir, "events").select(
        F.when(event % 20 == 1, event - 1).otherwise(event).alias("order_id"),
        F.when(event % 50 == 7, customer + UNKNOWN).otherwise(customer).alias("customer_id"),
        F.round(F.col("value") + (event % 7) * F.lit(0.001), 3).alias("order_total_amount"),
        F.col("ts").alias("order_created_at"),
        (F.col("event_type") == "signup").alias("order_scheduled"),
    )


def text(c: Column) -> Column:
    return c.cast("string")


def time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's complete raw record as one line of JSON text, some with fields that the schema
    lacks; some lines and values are broken."""
    id_ = F.col("order_id")

    def digits(c: Column, n: int) -> Column:
        return F.lpad((c % (10**n)).cast("string"), n, "0")

    fields = {
        "cpf": F.lpad(text(F.col("customer_id")), 11, "0"),
        "customer_id": text(F.col("customer_id")),
        "customer_name": F.concat(F.lit("customer "), F.col("customer_id")),
        "delivery_address_city": F.concat(F.lit("city "), id_ % 30),
        "delivery_address_country": F.lit("BR"),
        "delivery_address_district": F.when(id_ % 3 > 0, F.concat(F.lit("district "), id_ % 7)),
        "delivery_address_external_id": text(id_ * 7),
        "delivery_address_latitude": F.when(id_ % 90 == 0, "n/a").otherwise(
            F.concat(F.lit("-"), id_ % 60, F.lit("."), digits(id_, 3))
        ),
        "delivery_address_longitude": F.concat(id_ % 180, F.lit("."), digits(id_, 2)),
        "delivery_address_state": F.concat(F.lit("S"), id_ % 27),
        "delivery_address_zip_code": F.lpad(text(id_ % 99999), 8, "0"),
        "items": F.col("items"),
        "merchant_id": text(F.col("merchant_id")),
        "merchant_latitude": F.concat(id_ % 45, F.lit("."), digits(id_, 4)),
        "merchant_longitude": F.concat(F.lit("-"), id_ % 99, F.lit("."), digits(id_, 1)),
        "order_created_at": F.when(id_ % 101 == 7, "yesterday").otherwise(time(F.col("order_created_at"))),
        "order_id": text(id_),
        "origin_platform": F.array(F.lit("ANDROID"), F.lit("IOS"), F.lit("DESKTOP"))[(id_ % 3).cast("int")],
        "order_scheduled_date": F.when(id_ % 4 == 0, time(F.col("order_created_at") + F.make_dt_interval(F.lit(1)))),
        "order_scheduled": F.when(id_ % 67 == 0, "maybe").otherwise(text(F.col("order_scheduled"))),
        "order_total_amount": F.when(id_ % 77 == 0, "abc").otherwise(text(F.col("order_total_amount"))),
    }
    more = {
        "app_version": F.when(id_ % 3 == 0, F.concat(F.lit("9."), id_ % 12)),
        "loyalty": F.when(id_ % 10 == 4, F.struct((id_ % 4).alias("tier"))),
        "courier_id": F.when(id_ % 5 == 2, id_ % 1000),
    }
    named = [fields[f.name].alias(f.name) for f in ORDER_RAW] + [value.alias(name) for name, value in more.items()]
    record = F.to_json(F.struct(*named))
    line = F.when(id_ % 97 == 5, F.left(record, F.lit(40))).otherwise(record)
    return orders_a_raw(spark, sf_dir).select(line.alias("value"))


def dimension_texts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The dimension tables as text, whole numbers with a point, as an export with gaps writes them."""
    tables = {"consumer": consumer, "ab_test_ref": ab_test_ref, "restaurant": restaurant}
    out = {}
    for (name, make), schema in zip(tables.items(), (CONSUMER, AB_TEST_REF, RESTAURANT)):
        rows = make(spark, sf_dir)
        kinds = dict(rows.dtypes)
        texts = {
            "timestamp_ntz": time,
            "int": lambda c: c.cast("double").cast("string"),
        }
        out[name] = rows.select(
            *[texts.get(kinds[f.name], text)(F.col(f.name)).alias(f.name) for f in schema]
        )
    return out


def write_raw(spark: SparkSession, sf_dir: str, folder: str) -> tuple[str, str]:
    """The raw layer as files under ``folder``: gzip JSON lines, and header CSVs by name."""
    order_texts(spark, sf_dir).write.option("compression", "gzip").text(f"{folder}/orders")
    for name, rows in dimension_texts(spark, sf_dir).items():
        rows.write.option("header", True).csv(f"{folder}/dimensions/{name}.csv")
    return f"{folder}/orders", f"{folder}/dimensions"
