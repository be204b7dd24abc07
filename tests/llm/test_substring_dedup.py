from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
from brute import ODD, SMALL
from pyspark.sql import functions as F

from campaign_analytics.llm import queries, substring_dedup


def test_against_brute_force(spark, documents):
    found = {r[0]: tuple(r)[1:] for r in queries.op5_substring_dedup(spark, SMALL).collect()}
    assert found == brute.substring_dedup(documents, 20)


def test_overlaps_within_and_between_documents(spark):
    rng = random.Random(5)
    docs = [(i * 3 - 20, " ".join(rng.choices("ab", k=rng.randrange(120)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = substring_dedup.remove_repeats(frame, window=6, windows_per_bucket=50)
    rows = {r[0]: (r[1], r[2], brute.sha(r[3])) for r in found.collect()}
    assert rows == brute.substring_dedup(docs, 6)


def test_intervals_are_maximal_and_match(spark):
    text = " ".join(str(i) for i in range(50))
    frame = spark.createDataFrame([(1, text), (2, "x " + text + " y"), (3, "5 6 7")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame).collect()}
    assert rows[1]["removed"] == [] and rows[1]["kept_text"] == text
    assert [tuple(x) for x in rows[2]["removed"]] == [(1, 51)] and rows[2]["kept_text"] == "x y"
    assert rows[3]["n_removed"] == 0


def test_odd_rows(odd, empty):
    found = substring_dedup.remove_repeats(odd, window=5)
    rows = found.select("doc_id", "n_words", "n_removed").collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2]))
    # the null id comes first, so its eight words are first seen there
    assert sorted(by[None]) == [(0, 0), (len(brute.words(ODD[8][1])), 0)]
    assert by[1] == [(10, 8)] and by[2] == [(10, 10), (10, 10)]
    assert by[3] == by[4] == by[5] == [(0, 0)]
    assert by[7] == [(60_001, 60_000)]
    assert substring_dedup.remove_repeats(empty).collect() == []


def test_one_id_with_two_texts(spark):
    a = " ".join(str(i) for i in range(30))
    frame = spark.createDataFrame([(1, a), (1, a + " z"), (1, a)], "doc_id long, text string")
    rows = substring_dedup.remove_repeats(frame).orderBy("n_words").select("n_words", "n_removed").collect()
    first, second = [r[1] for r in rows if r[0] == 30], [r[1] for r in rows if r[0] == 31]
    assert (first, second) in (([0, 0], [30]), ([30, 30], [0]))


def test_hot_passage_over_many_partitions(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " "), F.col("id")).alias("text"))
    found = substring_dedup.remove_repeats(frame.repartition(16), windows_per_bucket=500)
    assert sorted(r[0] for r in found.select("n_removed").collect()) == [0] + [40] * 2999


def test_rows_of_one_id_go_to_many_groups(spark, monkeypatch):
    """A third of all rows under a null id, and a third one row again and again: no group holds them."""
    line = lambda i: " ".join(f"w{i * 31 + j}" for j in range(40))
    rows = [(None, line(i)) for i in range(300)] + [(5, line(1000))] * 300 + [(10 + i, line(5000 + i)) for i in range(300)]
    rows += [(2000, line(3)), (2001, line(1000))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(substring_dedup, "BYTES_PER_DOC_GROUP", 4000)
    monkeypatch.setattr(substring_dedup, "_COPIES", 7)
    found = substring_dedup.remove_repeats(frame, window=20)
    kept = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in found.collect())
    assert kept[None, 40, 0] == 300 and kept[5, 40, 0] == 300
    assert kept[2000, 40, 40] == 1 and kept[2001, 40, 40] == 1 and sum(kept.values()) == len(rows)
    ids = np.full(3000, substring_dedup._NONE)
    groups = substring_dedup._group_of(ids, np.arange(3000), 30)
    assert np.bincount(groups).max() < 160
