from __future__ import annotations

import math

import numpy as np
from brute import SMALL
from pyspark.sql import functions as F

from campaign_analytics.llm import cover_tree, queries


def brute(rows, k=10, every=100):
    """[(id, vector)] -> {(query, rank): (id, score)}"""
    whole = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows]
    out = {}
    for q, x in whole:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q)
            out |= {(q, r): (i, -s) for r, (s, i) in enumerate(found[:k], 1)}
    return out


def by_rank(frame):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in frame.collect()}


def test_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    frame = queries.op1_cover_tree(spark, SMALL)
    assert dict(frame.dtypes)["rank"] == "int"
    assert by_rank(frame) == brute([(r[0], r[1]) for r in rows])


def test_many_shards_and_ties(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([c + 0.05 * rng.normal(size=(120, 8)) for c in centres])
    x[300:600] = x[299]  # a vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = cover_tree.top_k(frame, F.col("vec_id") % 20 == 0, shard_rows=60, most_pivots=9, sample=200)
    assert by_rank(found) == brute(rows, every=20)
    parted = cover_tree.top_k(frame, F.col("vec_id") % 20 == 0, shard_rows=60, most_pivots=9, sample=200, query_rows=3)
    assert by_rank(parted) == by_rank(found)


def test_pruning_leaves_pairs_out():
    rng = np.random.Generator(np.random.PCG64(2))
    centres = 1000 * rng.normal(size=(20, 16))
    data = np.concatenate([c + rng.normal(size=(200, 16)) for c in centres]).astype(np.int64)
    queries_ = data[::40].copy()
    low = np.full(len(queries_), np.iinfo(np.int64).min)
    search = cover_tree.Search(queries_, np.arange(len(data))[::40], low, data, np.arange(len(data)), 10)
    search.run()
    assert search.pairs < 0.6 * len(queries_) * len(data)
    scores = queries_ @ data.T
    for i in range(len(queries_)):
        order = sorted((j for j in range(len(data)) if j != 40 * i), key=lambda j: (-scores[i, j], j))[:10]
        assert search.found[i].tolist() == order


def test_odd_rows(spark):
    rows = [
        (0, [0.5, 0.25], 1),
        (0, [0.5, 0.25], 1),
        (1, None, 1),
        (2, [0.1, None], 1),
        (3, [float("nan"), 0.0], 1),
        (4, [float("inf"), 0.0], 1),
        (5, [0.5], 1),
        (6, [0.5, 0.25, -1.0], 1),
        (None, [0.5, 0.5], 1),
        (7, [-0.0001, 0.0], 1),
        (100, [1.0, 1.0], 1),
        (8, [], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = by_rank(cover_tree.top_k(frame, F.col("vec_id") % 100 == 0))
    valid = {i: v for i, v, _ in rows if i in (0, 5, 6, 7, 8, 100)}
    assert found == brute(list(valid.items()))
    assert cover_tree.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    alone = cover_tree.top_k(frame.filter("vec_id = 100"), F.col("vec_id") % 100 == 0)
    assert alone.collect() == []
