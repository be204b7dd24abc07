"""Raw orders -> typed (silver) orders, and the optional keep-latest deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import to_coordinate, to_timestamp_lenient
from ..schemas import AMOUNT_COLUMNS, COORDINATE_COLUMNS, FLAG_COLUMNS, ITEMS, TIMESTAMP_COLUMNS


def typed_columns(raw: DataFrame) -> dict[str, Column]:
    """The typed expression of every raw column that is still text."""
    text = {name for name, kind in raw.dtypes if kind == "string"}
    changes = {}
    if "items" in text:
        changes["items"] = F.from_json(F.col("items"), ITEMS)
    changes |= {name: to_coordinate(name) for name in COORDINATE_COLUMNS if name in text}
    changes |= {name: to_timestamp_lenient(name) for name in TIMESTAMP_COLUMNS if name in text}
    changes |= {name: F.col(name).try_cast("boolean") for name in FLAG_COLUMNS if name in text}
    changes |= {name: F.col(name).try_cast("double") for name in AMOUNT_COLUMNS if name in text}
    return changes


def type_orders(raw: DataFrame) -> DataFrame:
    """Parse the item JSON, cast coordinates to 2-place doubles, amounts, flags and timestamps.

    One projection, narrow (no shuffle).  Only columns present are touched, so the same
    function types the full raw record and a reduced test model.  Malformed values become
    NULL rather than failing the job; ``quality.malformed_orders`` counts them.
    """
    changes = typed_columns(raw)
    return raw.withColumns(changes) if changes else raw


def keep_latest_order(orders: DataFrame, key: str = "order_id", order_by: str = "order_created_at") -> DataFrame:
    """One row per ``key``: the latest by ``order_by``; ties broken by the other columns.

    Ids are counted first, over the key column alone.  Rows whose id stands once, nearly
    all, pass through; only rows of repeated ids are compared (``max`` of a struct that leads
    with the timestamp, one candidate per id and task before the shuffle).  NULL timestamps
    lose to any timestamp, and NULL ids are one id.
    """
    others = [order_by, *[c for c in orders.columns if c not in (key, order_by)]]
    counts = orders.groupBy(F.col(key).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = counts.filter("_n > 1").select("_id")
    same = F.col(key).eqNullSafe(F.col("_id"))
    once = orders.join(repeated, same, "left_anti")
    best = F.max(F.struct(*[F.col(c) for c in others])).alias("_best")
    latest = orders.join(repeated, same, "left_semi").groupBy(key).agg(best)
    latest = latest.select(key, *[F.col(f"_best.{c}").alias(c) for c in others]).select(*orders.columns)
    return once.unionByName(latest)
