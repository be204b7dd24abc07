"""Readers for the raw (bronze), silver and gold layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import to_whole_number
from ..schemas import CORRUPT_RECORD, ORDER_RAW, ORDER_RAW_READ
from ..session import default_parallelism


def read_raw_orders(
    spark: SparkSession,
    path: str,
    partitions: int | None = None,
    spread: bool = True,
    keep_corrupt: bool = False,
) -> DataFrame:
    """JSON-lines order records (gzip or plain) with the declared raw schema, all text.

    A declared schema skips the inference pass over the input.  Spark's JSON reader parses
    every input, so the rows are the same however many files there are: an array line gives
    one row per record, a blank line none, a broken record a row of NULL fields whose text
    ``keep_corrupt`` returns in ``_corrupt_record`` (``quality.malformed_orders`` counts
    them).  A gzip file is read by one task; with ``spread``, when there are fewer read
    tasks than ``partitions``, the parsed rows are dealt out for the typing that follows.
    """
    df = spark.read.schema(ORDER_RAW_READ).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT_RECORD
    ).json(path)
    if not keep_corrupt:
        df = df.select(*[f.name for f in ORDER_RAW])
    target = partitions or default_parallelism(spark)
    return df.repartition(target) if spread and _read_tasks(df) < target else df


def _read_tasks(df: DataFrame) -> int:
    """Number of read tasks the scan plans (file listing only, no job)."""
    try:
        return df.rdd.getNumPartitions()
    except Exception:  # no RDD API (Spark Connect): one task per file is the floor
        return len(df.inputFiles())


def _typed(col: str, dtype: T.DataType):
    if isinstance(dtype, T.TimestampType):
        return F.try_to_timestamp(F.col(col))
    if isinstance(dtype, T.IntegerType):
        return to_whole_number(col)
    return F.col(col).try_cast(dtype)


def read_dimension_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The declared columns of a header CSV, as text; a missing column is an error."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return raw.select(*[f.name for f in schema.fields])


def read_dimension_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: a header CSV read as text, then each declared column typed by name.

    Extra columns in the file are ignored; a declared column missing from the file is
    an error; unparseable values become NULL.
    """
    return type_dimension(read_dimension_text(spark, path, schema), schema)


def type_dimension(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to their declared types; a whole number may be written with a point (``3.0``)."""
    return raw.select(*[_typed(f.name, f.dataType).alias(f.name) for f in schema.fields])


def read_layer(spark: SparkSession, location: str) -> DataFrame:
    """A silver or gold table, by path (Parquet) or by catalog table name."""
    if "/" in location or location.startswith(("file:", "s3", "hdfs:", "abfs", "gs:")):
        return spark.read.parquet(location)
    return spark.table(location)
