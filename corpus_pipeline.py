"""Corpus pipeline: filter by quality, drop near-duplicates, sanitise, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run``
applies them to the documents table, writing what each stage returns as Parquet in the
shared checkpoint folder and reading it again.

In every stage an empty table gives no rows, and columns beyond those of documents stay as they
are, whatever their names, in all stages but the last.  What a stage does with null ids and
texts, empty and very long texts, and repeated rows is said in its docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from campaign_analytics.llm import mixing, packing, pii, quality_crf, simhash_vp
from campaign_analytics.llm.common import table
from campaign_analytics.llm.queries import PACKING_TOKENIZER
from campaign_analytics.session import ensure_checkpoint_dir


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go.

    Null and empty texts score 0 and go.  Null ids and repeated rows: each row by its own text.
    Very long texts are scored whole.
    """
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id.

    Null and empty texts have one fingerprint and are a group.  Null ids come after all others;
    of rows with one id the one of the smallest row hash stays, and of equal rows one.
    """
    return simhash_vp.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it are replaced in the texts.

    All rows stay.  Null texts stay null, empty ones empty; long texts are cut part by part.  Null
    ids and repeated rows are rows like others.
    """
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' budgets take them.

    A null source is a source, the last one; rows without words (null and empty texts) go.  One
    document per source may be cut where the budget ends, and rows equal to it share the rest.
    Null ids and repeated rows are rows like others.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document.

    Null and empty texts are their closing id alone; long ones are cut into full sequences.  Null and
    repeated ids: each row is a document of its own.
    """
    return packing.pack(docs, PACKING_TOKENIZER)


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", sanitise),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier, SimHash and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus: what the last stage returns, after all others."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
