"""Labelled rows that a classifier is fitted on: a bounded sample, held-out rows never in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT_PARTS = 5


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text has remainder 0 modulo 5; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_PARTS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int) -> DataFrame:
    """text, label (0 or 1) of at most ``rows_per_class`` labelled documents of each class.

    Which ones is decided by a hash of the id, so reruns agree.  Rows held out, and rows with
    a null id, text or label, are never taken; a document with both labels has none, and of
    rows with one id the first text in order is taken.
    """
    known = labels.select(F.col("doc_id").alias("labelled_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("labelled_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.filter(~is_held_out(F.col("labelled_id")))
    single = known.groupBy("labelled_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    single = single.filter("label = other").select("labelled_id", "label")
    drawn = [
        single.filter(F.col("label") == value).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(rows_per_class)
        for value in (0, 1)
    ]
    # 2 * rows_per_class rows of two numbers: small whatever the tables
    chosen = F.broadcast(drawn[0].union(drawn[1]))
    found = docs.filter("text is not null").join(chosen, F.col("doc_id") == F.col("labelled_id"))
    # one text for each id, however often the table repeats it
    texts = found.groupBy("labelled_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return texts.select("text", "label")
