from __future__ import annotations

import brute
import numpy as np
from brute import ODD, SMALL

from campaign_analytics.llm import queries, simhash_vp


def test_against_all_pairs(spark, documents):
    found = {r[0]: (r[1], r[2]) for r in queries.op4_simhash_vp(spark, SMALL).collect()}
    assert found == brute.near_duplicates(documents)


def test_search_finds_every_link_with_small_shards():
    rng = np.random.Generator(np.random.PCG64(3))
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    far = near[:300] ^ (np.uint64(3) << rng.integers(0, 62, 300).astype(np.uint64))
    values = np.unique(np.concatenate([base, near, far]))
    tree = simhash_vp.shard_tree(values[::3], 3.0, 2, 200)
    assert tree is not None
    at = {int(v): i for i, v in enumerate(values)}
    forest = simhash_vp.Forest(len(values))
    for _, members in simhash_vp.route(tree, values, 2):
        own = simhash_vp.linked(members, 2, block=16)
        for i in range(len(members)):
            forest.join(at[int(members[i])], at[int(members[own.find(i)])])
    whole = simhash_vp.Forest(len(values))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 2):
            whole.join(i, int(j))
    assert [forest.find(i) for i in range(len(values))] == [whole.find(i) for i in range(len(values))]


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9), (5, 5)]
    found = {r[0]: r[1] for r in simhash_vp.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(101, 141)}, 7: 3, 9: 3}


def test_odd_rows(odd, empty):
    found = simhash_vp.near_duplicates(odd)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    rows = found.collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2]))
    assert by[1] == [(f"{brute.simhash(ODD[0][1]):016x}", 1)] and by[2] == 2 * by[1]
    assert by[3] == by[4] == by[5] == [("0" * 16, 3)]
    assert sorted(by[None]) == sorted([("0" * 16, 3), (f"{brute.simhash(ODD[8][1]):016x}", None)])
    assert simhash_vp.near_duplicates(empty).collect() == []


def test_keep_one(odd, empty):
    kept = simhash_vp.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(2) == 0 and ids.count(3) == 1 and ids.count(4) == 0
    assert len(ids) == len({c for c in [r[2] for r in simhash_vp.near_duplicates(odd).collect()]})
    assert simhash_vp.keep_one(odd.union(odd)).count() == len(ids)
    assert simhash_vp.keep_one(empty).count() == 0
