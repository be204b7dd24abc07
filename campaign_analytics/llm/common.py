"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed value: a word is a maximal run of code points other than the space and U+0009..U+000D.
# ``bytes.split()`` on UTF-8 cuts at exactly these six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable_on_workers(spark: SparkSession) -> None:
    """Python workers of this machine import the package from where the driver has it.

    On a cluster the package is shipped with ``--py-files`` or installed; the extra path
    entry does nothing there.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint (shared folder)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(frame: DataFrame, path: str) -> DataFrame:
    """A table of few rows with large values, in a shared folder, and read again by column.

    Only a few values are held before they are written; they are compressed already.
    """
    writer = frame.write.option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1)
    writer.option("compression", "none").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def as_utf8(text: DataFrame | str = "text"):
    """The text column as a string; any other type is cast, null stays null."""
    return F.col(text).cast("string")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns of any name cannot clash."""
    importable_on_workers(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), as_utf8(text_col).alias("text"), *[F.col(c) for c in more])


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``docs`` has it."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[tuple[int, list[str | None]]]:
    """Cut an Arrow batch into runs of rows of about ``max_bytes`` of text (one row at least).

    Yields (first row, texts); keeps the Python strings alive one run at a time.
    """
    values = batch.column(column)
    start, size, run = 0, 0, []
    for i in range(len(values)):
        value = values[i].as_py()
        run.append(value)
        size += len(value.encode()) if value else 0
        if size >= max_bytes:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run
