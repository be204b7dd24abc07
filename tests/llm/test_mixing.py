from __future__ import annotations

import brute
import pytest
from brute import SMALL
from pyspark.sql import functions as F

from campaign_analytics.llm import mixing, queries


def check(frame, rows):
    sizes, own = {}, {}
    for doc_id, text, source in frame.select("doc_id", "text", "source").collect():
        sizes[source] = sizes.get(source, 0) + len(brute.words(text))
        own.setdefault(doc_id, []).append((len(brute.words(text)), source))
    wanted = brute.targets(sizes)
    taken = {}
    for r in rows:
        assert any(r["size"] == n and r["source_size"] == sizes[s] and r["target"] == pytest.approx(wanted[s]) for n, s in own[r["doc_id"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert n == int(wanted[s] + 1e-6), s


def test_budgets_are_met_exactly(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.mix(docs, rows_per_range=3).collect()
    assert len(rows) == docs.count()
    check(docs, rows)
    again = mixing.mix(docs.repartition(5)).select("doc_id", "taken").collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in again}
    assert queries.op8_mixing(spark, SMALL).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_hot_source(spark):
    frame = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"),
    )
    check(frame, mixing.mix(frame, rows_per_range=100).collect())


def test_odd_rows(odd, empty):
    check(odd, mixing.mix(odd).collect())
    assert mixing.mix(empty).collect() == []


def test_documents_of_the_mix(odd, empty):
    rows = {}
    for r in mixing.mix(odd).collect():
        rows[r["source"]] = rows.get(r["source"], 0) + r["taken"]
    docs = mixing.mixed_documents(odd)
    assert docs.columns == odd.columns
    words = {}
    for r in docs.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(brute.words(r["text"]))
    assert {s: n for s, n in rows.items() if n} == {s: n for s, n in words.items() if n}
    assert mixing.mixed_documents(empty).count() == 0
