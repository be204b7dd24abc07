"""The raw -> silver and silver -> gold layers as incremental Structured Streaming jobs.

Orders arrive as new JSON files; each run processes only files not yet seen (the
checkpoint remembers them) and appends to the layer.

* silver: file source -> :func:`quality.type_observed` -> Parquet file sink.  The sink's commit
  log makes the output exactly-once; batch readers of the folder see committed files only.
  What a batch lost (broken lines, values that do not parse) is in the progress of the query,
  under the metrics named :data:`LOST`.
* gold: silver file source -> ``foreachBatch``: each micro-batch is a static DataFrame,
  so :func:`build_abt` (with its hot-key handling) applies unchanged.  Orders whose customer
  has no A/B group yet wait beside the gold rows.  Only a batch that finds another A/B table
  than the batch before takes the waiting orders up again; the others add their own, so the
  work of a batch does not grow with the customers that never get a group.  An order enters
  gold with the first batch that finds its customer assigned; the other attributes are those
  of that batch.  Every folder is named by its batch and overwritten, so a batch replayed after
  a failure replaces its earlier partial output instead of duplicating it.  Read the gold
  folder with :func:`read_gold_batches`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import quality
from ..operators.joins import HOT_KEY_ROWS, build_abt
from ..schemas import CORRUPT_RECORD, ORDER_RAW_READ

#: Name of the silver stream's metrics in its progress (``observedMetrics``).
LOST = "lost"


def stream_silver_orders(
    spark: SparkSession,
    raw_dir: str,
    silver_dir: str,
    checkpoint_location: str,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the raw -> silver stream (``available_now``: process the backlog, then stop)."""
    reader = spark.readStream.schema(ORDER_RAW_READ).option("columnNameOfCorruptRecord", CORRUPT_RECORD)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    typed = quality.type_observed(reader.json(raw_dir), LOST)
    writer = (
        typed.writeStream.format("parquet")
        .option("path", silver_dir)
        .option("checkpointLocation", checkpoint_location)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def _batch_folder(gold_dir: str, kind: str, batch_id: int) -> str:
    return f"{gold_dir.rstrip('/')}/{kind}/batch_{batch_id:09d}"


def _read(spark: SparkSession, *paths: str) -> DataFrame | None:
    """A table of a batch before; None if there was no such batch."""
    try:
        return spark.read.parquet(*paths)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _fingerprint(ab_test_ref: DataFrame) -> tuple[int, int]:
    """Two numbers that tell one A/B table from another, whatever the order of its rows."""
    rows = F.xxhash64("customer_id", "is_target").cast("decimal(20,0)")
    found = ab_test_ref.agg(F.count(F.lit(1)), F.coalesce(F.sum(rows), F.lit(0)) % (1 << 62)).first()
    return found[0], int(found[1])


def _gold_writer(
    dims: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], gold_dir: str, hot_key_rows: int
) -> Callable[[DataFrame, int], None]:
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        consumer, ab_test_ref, restaurant = dims()
        n, mark = _fingerprint(ab_test_ref)
        last = _read(spark, _batch_folder(gold_dir, "state", batch_id - 1))
        state = last.first() if last is not None else None
        orders, first = batch, batch_id
        if state is not None and (state["ab_rows"], state["ab_mark"]) == (n, mark):
            first = state["first_waiting"]  # the same table: who waits goes on waiting
        elif state is not None:
            folders = [_batch_folder(gold_dir, "waiting", i) for i in range(state["first_waiting"], batch_id)]
            orders = batch.unionByName(spark.read.parquet(*folders))
        abt = build_abt(orders, consumer, ab_test_ref, restaurant, hot_key_rows)
        abt.write.mode("overwrite").parquet(_batch_folder(gold_dir, "rows", batch_id))
        assigned = ab_test_ref.select("customer_id")
        unmatched = orders.filter(F.col("customer_id").isNotNull()).join(assigned, "customer_id", "left_anti")
        unmatched.select(*orders.columns).write.mode("overwrite").parquet(_batch_folder(gold_dir, "waiting", batch_id))
        row = spark.createDataFrame([(n, mark, first)], "ab_rows long, ab_mark long, first_waiting long")
        row.write.mode("overwrite").parquet(_batch_folder(gold_dir, "state", batch_id))

    return write_batch


def stream_gold_abt(
    spark: SparkSession,
    silver_dir: str,
    dims: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    gold_dir: str,
    checkpoint_location: str,
    hot_key_rows: int = HOT_KEY_ROWS,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the silver -> gold stream.

    ``dims`` returns ``(consumer, ab_test_ref, restaurant)``; it is called per batch so
    dimension updates are picked up.
    """
    silver_schema = spark.read.parquet(silver_dir).schema
    source = spark.readStream.schema(silver_schema).parquet(silver_dir)
    writer = (
        source.writeStream.foreachBatch(_gold_writer(dims, gold_dir, hot_key_rows))
        .option("checkpointLocation", checkpoint_location)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_gold_batches(spark: SparkSession, gold_dir: str) -> DataFrame:
    """The gold ABT written by :func:`stream_gold_abt` (all batch folders)."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{gold_dir.rstrip('/')}/rows")
