"""Data-quality checks C1-C4 on the silver tables, each one small DataFrame.

C1 and C4 avoid anti-joins and per-table scans of the whole key space by tagging every
id with its source and aggregating once by id (partial aggregation, so a hot id is one
row per task).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import exact_sum, money, share_pct
from ..schemas import AMOUNT_COLUMNS, CORRUPT_RECORD
from .ingest import typed_columns


def missing_consumer(orders: DataFrame, ab_test_ref: DataFrame, consumer: DataFrame) -> DataFrame:
    """Customer ids in orders / the A/B table, and how many of them consumer lacks."""

    def tag(df: DataFrame, o: int, a: int, c: int) -> DataFrame:
        return df.select("customer_id", F.lit(o).alias("o"), F.lit(a).alias("a"), F.lit(c).alias("c"))

    tagged = tag(orders, 1, 0, 0).unionByName(tag(ab_test_ref, 0, 1, 0)).unionByName(tag(consumer, 0, 0, 1))
    per_id = (
        tagged.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.max("o").alias("o"), F.max("a").alias("a"), F.max("c").alias("c"))
    )
    missing = 1 - F.col("c")
    return per_id.agg(
        F.sum("o").cast("bigint").alias("order_customers"),
        F.sum(F.col("o") * missing).cast("bigint").alias("order_customers_missing_consumer"),
        F.sum("a").cast("bigint").alias("ab_customers"),
        F.sum(F.col("a") * missing).cast("bigint").alias("ab_customers_missing_consumer"),
        F.sum(F.greatest("o", "a") * missing).cast("bigint").alias("known_customers_missing_consumer"),
        F.sum("c").cast("bigint").alias("consumer_customers"),
    )


def null_customer(orders: DataFrame) -> DataFrame:
    """Rows, distinct orders and revenue with a NULL customer, and their shares."""
    is_null = F.col("customer_id").isNull()
    agg = orders.agg(
        F.count(F.lit(1)).alias("order_rows"),
        F.count_if(is_null).alias("null_customer_rows"),
        F.countDistinct("order_id").alias("order_count"),
        F.countDistinct(F.when(is_null, F.col("order_id"))).alias("null_customer_orders"),
        exact_sum("order_total_amount").alias("revenue"),
        exact_sum(F.when(is_null, F.col("order_total_amount"))).alias("null_customer_revenue"),
    )
    return agg.withColumn("null_order_pct", share_pct("null_customer_orders", "order_count")).withColumn(
        "null_revenue_pct", share_pct("null_customer_revenue", "revenue")
    )


def repeated_orders(orders: DataFrame, identity_cols: list[str] | None = None) -> DataFrame:
    """Order ids that occur with several customers / identities or creation times.

    An id that stands once can have no second identity: ids are counted over their column
    alone, and the distinct counts run over the rows of repeated ids only.
    """
    identity_cols = identity_cols or [c for c in ("customer_id", "cpf") if c in orders.columns]
    checked = [*identity_cols, "order_created_at"]
    counts = orders.groupBy(F.col("order_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = counts.filter("_n > 1").select("_id")
    rows = orders.select("order_id", *checked).join(repeated, F.col("order_id").eqNullSafe(F.col("_id")), "left_semi")
    distinct = [F.countDistinct(c).alias(f"distinct_{c}") for c in checked]
    found = rows.groupBy("order_id").agg(F.count(F.lit(1)).alias("row_count"), *distinct)
    return found.filter(reduce(lambda a, b: a | b, [F.col(f"distinct_{c}") > 1 for c in checked]))


def _lost_counts(typed: dict[str, Column], corrupt: str) -> dict[str, tuple[Column, Column]]:
    """Per column (and ``record`` for whole records): aggregates of the values given and of those lost."""
    counts = {"record": (F.count(F.lit(1)), F.count_if(F.col(corrupt).isNotNull()))}
    for name, value in typed.items():
        given = F.col(name).isNotNull() & (F.trim(F.col(name)) != "")
        kept = money(value) if name in AMOUNT_COLUMNS else value
        counts[name] = (F.count_if(given), F.count_if(given & kept.isNull()))
    return counts


def _wide(counts: dict[str, tuple[Column, Column]]) -> list[Column]:
    return [c.alias(f"{k}_{name}") for name, pair in counts.items() for k, c in zip(("all", "lost"), pair)]


def malformed_orders(raw: DataFrame, corrupt: str = CORRUPT_RECORD) -> DataFrame:
    """What reading and typing lost: broken records (``column_name`` ``record``) and failed casts.

    Per typed column the values that are there as text, and those of them that do not parse (an
    amount also if it is beyond what money sums hold); one aggregation over the raw rows for all.
    ``raw`` comes from ``read_raw_orders(..., keep_corrupt=True)``.
    """
    counts = _lost_counts(typed_columns(raw), corrupt)

    def row(name: str) -> Column:
        parts = {"column_name": F.lit(name), "value_count": F.col(f"all_{name}"), "lost_count": F.col(f"lost_{name}")}
        return F.struct(*[c.alias(k) for k, c in parts.items()])

    return raw.agg(*_wide(counts)).select(F.inline(F.array(*[row(name) for name in counts])))


def type_observed(raw: DataFrame, observation: Observation | str, corrupt: str = CORRUPT_RECORD) -> DataFrame:
    """``ingest.type_orders`` of the raw rows, counting what is lost on the way.

    The counts of :func:`malformed_orders` and, of C2, the rows without a customer and their
    revenue are gathered by the job that writes the rows: no second scan.  Let nothing that
    shuffles stand between this and the write, for a repeated map stage would count again.
    ``observation`` is an ``Observation``, or the name of the metrics of a stream.
    """
    typed = typed_columns(raw)
    named = raw.withColumns({f"_typed_{name}": value for name, value in typed.items()})
    nobody = F.col("customer_id").isNull()
    amount = money(F.col("_typed_order_total_amount"))
    more = [
        F.count_if(nobody).alias("null_customer_rows"),
        F.sum(amount).alias("revenue"),
        F.sum(F.when(nobody, amount)).alias("null_customer_revenue"),
    ]
    counts = _lost_counts({name: F.col(f"_typed_{name}") for name in typed}, corrupt)
    seen = named.observe(observation, *_wide(counts), *more)
    kept = [c for c in raw.columns if c != corrupt]
    return seen.select(*[F.col(f"_typed_{c}").alias(c) if c in typed else F.col(c) for c in kept])


def observed_rows(spark: SparkSession, metrics: dict) -> DataFrame:
    """The metrics of :func:`type_observed` as rows of :func:`malformed_orders`, with ``customer_id``
    for the rows without a customer."""
    names = [k.removeprefix("all_") for k in metrics if k.startswith("all_")]
    rows = [(name, metrics[f"all_{name}"], metrics[f"lost_{name}"]) for name in names]
    rows.append(("customer_id", metrics["all_record"], metrics["null_customer_rows"]))
    # one row per column
    return spark.createDataFrame(rows, "column_name string, value_count long, lost_count long")


def duplicate_keys(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """C4: per dimension table - rows, distinct keys (NULL counts as one), duplicated keys."""
    parts = []
    for name, (df, key) in tables.items():
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(
            per_key.agg(
                F.sum("_n").cast("bigint").alias("row_count"),
                F.count(F.lit(1)).alias("key_count"),
                F.count_if(F.col("_n") > 1).alias("duplicated_keys"),
            ).select(F.lit(name).alias("table_name"), "row_count", "key_count", "duplicated_keys")
        )
    return reduce(DataFrame.unionByName, parts)

