"""D3, W4 as a stream: one row per order id, the latest, while files keep arriving and are replayed.

Each micro-batch keeps the latest row of its own ids and writes them as a delta folder named by
the batch; a replayed batch overwrites its folder.  Reading merges the last compacted base with
the deltas after it.  The latest row is a maximum, so it does not matter how often or in which
batch a row arrived.  Compaction writes a new base beside the old one; the folder's name says up
to which batch it reaches, and only a complete one is read, so a lost compaction is harmless.
The work of a batch is that of its own rows, not of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import keep_latest_order, type_orders
from ..schemas import ORDER_RAW

_BASE, _DELTA, _DIGITS = "base/upto_", "delta/batch_", 12


def _folder(table: str, kind: str, batch_id: int) -> str:
    return f"{table.rstrip('/')}/{kind}{batch_id:0{_DIGITS}d}"


def _batches(spark: SparkSession, table: str, kind: str) -> list[int]:
    """Batch numbers of the complete folders of a kind (a listing by Hadoop, of any file system)."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{table.rstrip('/')}/{kind}*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName()[-_DIGITS:]) for f in found)


def write_batch(table: str, key: str = "order_id") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the batch's latest row per key as its delta folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        keep_latest_order(batch, key).write.mode("overwrite").parquet(_folder(table, _DELTA, batch_id))

    return write


def stream_latest_orders(
    spark: SparkSession,
    raw_dir: str,
    table: str,
    checkpoint_location: str,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream from raw JSON files into ``table`` (``available_now``: the backlog, then stop)."""
    reader = spark.readStream.schema(ORDER_RAW)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = type_orders(reader.json(raw_dir)).writeStream.foreachBatch(write_batch(table))
    writer = writer.option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def _parts(spark: SparkSession, table: str) -> tuple[list[str], int]:
    """The folders that make up the table, and the last batch among them (-1: none)."""
    bases = _batches(spark, table, _BASE)
    upto = bases[-1] if bases else -1
    deltas = [b for b in _batches(spark, table, _DELTA) if b > upto]
    folders = [_folder(table, _BASE, upto)] if bases else []
    return folders + [_folder(table, _DELTA, b) for b in deltas], max([upto, *deltas])


def read_latest_orders(spark: SparkSession, table: str, key: str = "order_id") -> DataFrame | None:
    """The latest row of every key over the base and the deltas after it; None if nothing was written."""
    folders, _ = _parts(spark, table)
    return keep_latest_order(spark.read.parquet(*folders), key) if folders else None


def compact(spark: SparkSession, table: str, key: str = "order_id") -> None:
    """A new base of all that the table holds now; run it between streams or beside one."""
    folders, last = _parts(spark, table)
    if len(folders) > 1 or (folders and "/delta/" in folders[0]):
        latest = keep_latest_order(spark.read.parquet(*folders), key)
        latest.write.mode("overwrite").parquet(_folder(table, _BASE, last))
