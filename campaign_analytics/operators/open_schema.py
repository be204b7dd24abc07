"""What the declared schemas leave out, counted instead of lost.

Raw lines and item documents are parsed to VARIANT, whatever fields they have.  Fields are
counted by one aggregation whose state is a field's count and its merged type, so tasks
combine their parts and the pass scales with the input, not with the number of fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ITEM, ORDER_RAW


def _elements(value: Column) -> Column:
    """The elements of a VARIANT array; any other value as the only element."""
    is_array = F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))
    return F.when(is_array, F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))


def _fields(documents: DataFrame, declared: list[str]) -> DataFrame:
    """field_name, value_count, value_type of the documents' fields that are not declared.

    ``documents`` has one VARIANT column ``document`` that is an object, or has no field.
    """
    spark = documents.sparkSession
    documents = documents.filter(F.startswith(F.schema_of_variant("document"), F.lit("OBJECT")))
    found = documents.lateralJoin(spark.tvf.variant_explode(F.col("document").outer()))
    others = found.filter(~F.col("key").isin(declared)) if declared else found
    return others.groupBy(F.col("key").alias("field_name")).agg(
        F.count(F.lit(1)).alias("value_count"), F.schema_of_variant_agg("value").alias("value_type")
    )


def undeclared_fields(spark: SparkSession, path: str, declared: T.StructType = ORDER_RAW) -> DataFrame:
    """Fields of the raw JSON lines that the declared schema lacks, how many records have
    each, and the type that holds all its values.

    An array line counts as its records.  Lines that are no JSON have no fields here;
    ``quality.malformed_orders`` counts them.
    """
    line = F.try_parse_json("value")
    lines = spark.read.text(path).select(line.alias("line")).filter(F.col("line").isNotNull())
    records = lines.select(F.explode(_elements(F.col("line"))).alias("document"))
    return _fields(records, declared.names)


def items_as_variant(raw: DataFrame) -> DataFrame:
    """The orders with the item document as VARIANT (``items``) and what became of it (``items_state``).

    ``absent`` (no text), ``malformed`` (text that is no JSON), ``not_a_list``, ``empty`` or ``items``.
    """
    parsed = raw.withColumns({"_text": F.col("items"), "items": F.try_parse_json("items")})
    kind = F.schema_of_variant("items")
    size = F.size(F.try_variant_get("items", "$", "array<variant>"))
    state = (
        F.when(F.col("_text").isNull() | (F.trim("_text") == ""), "absent")
        .when(F.col("items").isNull(), "malformed")
        .when(~F.startswith(kind, F.lit("ARRAY")), "not_a_list")
        .when(size == 0, "empty")
        .otherwise("items")
    )
    return parsed.withColumn("items_state", state).drop("_text")


def item_rows(orders: DataFrame) -> DataFrame:
    """One row per item: order_id, ``item`` as VARIANT.  ``orders`` comes from :func:`items_as_variant`."""
    listed = orders.filter(F.col("items_state") == "items")
    elements = F.variant_get("items", "$", "array<variant>")
    return listed.select("order_id", F.explode(elements).alias("item"))


def item_values(items: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """The named values of each item: ``fields`` maps a column to its path and type.

    A value of another type is NULL, and so is a path that the item lacks.
    """
    values = [F.try_variant_get("item", path, kind).alias(name) for name, (path, kind) in fields.items()]
    return items.select("order_id", *values)


def undeclared_item_fields(items: DataFrame, declared: T.StructType = ITEM) -> DataFrame:
    """Fields of the items that the declared item schema lacks, as :func:`undeclared_fields`."""
    return _fields(items.select(F.col("item").alias("document")), declared.names)


def item_states(orders: DataFrame) -> DataFrame:
    """How many orders have their items in each state, and the items they have."""
    listed = F.when(F.col("items_state") == "items", F.size(F.try_variant_get("items", "$", "array<variant>")))
    return orders.groupBy("items_state").agg(
        F.count(F.lit(1)).alias("order_rows"), F.coalesce(F.sum(listed), F.lit(0)).alias("item_count")
    )
