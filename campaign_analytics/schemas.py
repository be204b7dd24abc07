"""Declared schemas of the raw order records and the dimension tables.

Declaring the schema of the raw JSON saves Spark the inference pass over the whole input
and pins the types, so a malformed file cannot silently change a column's type.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Field names of the order-item JSON documents, of the raw order records
# and (further below) of the dimension tables and the typed order columns.  They must
# equal the names in the source data.
MONEY_FIELDS = ["value", "currency"]
ITEM_FIELDS = [
    "name", "addition", "discount", "quantity", "sequence", "unitPrice", "externalId",
    "totalValue", "customerNote", "integrationId", "totalAddition", "totalDiscount", "garnishItems",
]
GARNISH_FIELDS = [
    "name", "addition", "discount", "quantity", "sequence", "unitPrice", "categoryId",
    "externalId", "totalValue", "categoryName", "integrationId",
]
MONEY_VALUED = {"addition", "discount", "unitPrice", "totalValue", "totalAddition", "totalDiscount"}
ORDER_STRING_FIELDS = [
    "cpf", "customer_id", "customer_name", "delivery_address_city", "delivery_address_country",
    "delivery_address_district", "delivery_address_external_id", "delivery_address_latitude",
    "delivery_address_longitude", "delivery_address_state", "delivery_address_zip_code", "items",
    "merchant_id", "merchant_latitude", "merchant_longitude", "order_created_at", "order_id",
    "origin_platform", "order_scheduled_date",
]

MONEY = T.StructType([T.StructField(name, T.StringType(), True) for name in MONEY_FIELDS])


def _item_struct(fields: list[str], nested: T.DataType | None = None) -> T.StructType:
    out = []
    for name in fields:
        if name == "garnishItems":
            out.append(T.StructField(name, nested, True))
        elif name in MONEY_VALUED:
            out.append(T.StructField(name, MONEY, True))
        else:
            out.append(T.StructField(name, T.StringType(), True))
    return T.StructType(out)


GARNISH_ITEM = _item_struct(GARNISH_FIELDS)
ITEM = _item_struct(ITEM_FIELDS, T.ArrayType(GARNISH_ITEM, True))
ITEMS = T.ArrayType(ITEM, True)

# Raw orders: every field is read as text, so a quoted amount or flag is not lost to a type
# mismatch; ``operators.ingest`` types them.  ``items`` holds a JSON document inside the record.
ORDER_RAW = T.StructType(
    [T.StructField(name, T.StringType(), True) for name in [*ORDER_STRING_FIELDS, "order_scheduled", "order_total_amount"]]
)
# The JSON reader puts the text of a record it cannot parse here.
CORRUPT_RECORD = "_corrupt_record"
ORDER_RAW_READ = T.StructType([*ORDER_RAW.fields, T.StructField(CORRUPT_RECORD, T.StringType(), True)])

CONSUMER = T.StructType([
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("active", T.BooleanType(), True),
])

AB_TEST_REF = T.StructType([
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("is_target", T.StringType(), True),
])

RESTAURANT = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("enabled", T.BooleanType(), True),
    T.StructField("price_range", T.IntegerType(), True),
    T.StructField("average_ticket", T.DoubleType(), True),
    T.StructField("delivery_time", T.IntegerType(), True),
    T.StructField("minimum_order_value", T.DoubleType(), True),
    T.StructField("merchant_city", T.StringType(), True),
    T.StructField("merchant_state", T.StringType(), True),
])

COORDINATE_COLUMNS = [
    "delivery_address_latitude", "delivery_address_longitude", "merchant_latitude", "merchant_longitude",
]
TIMESTAMP_COLUMNS = ["order_created_at", "order_scheduled_date"]
FLAG_COLUMNS = ["order_scheduled"]
AMOUNT_COLUMNS = ["order_total_amount"]
