from __future__ import annotations

import hashlib
import math

import numpy as np

from campaign_analytics.llm import ptolemaic


def brute(rows, k, rounds, dimensions):
    """[(id, vector)], ids distinct or null -> [(id, cluster, distance, cluster_inertia, inertia, centroid)]"""
    most = (1 << 63) - 1
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(a is not None and math.isfinite(a) for a in v):
            whole = [math.floor(1024 * a) if math.isfinite(1024 * a) else math.copysign(math.inf, a) for a in v]
            kept.append((i, [int(max(min(a, most), -most - 1)) for a in whole]))

    def key(row):
        return (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    centres = [v for _, v in sorted(kept, key=key)[:k]]

    def label(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(label(v)[1], []).append(v)
        for j, vs in members.items():
            centres[j] = [sum(a) // len(vs) for a in zip(*vs)]
    out = [(i, *label(v)[::-1]) for i, v in kept]
    sums = {j: min(sum(d if d < most else most for _, n, d in out if n == j), most) for _, j, _ in out}
    total = min(sum(min(d, most) for _, _, d in out), most)
    return sorted(
        ((i, j, min(d, most), sums[j], total, tuple(centres[j])) for i, j, d in out), key=lambda r: (str(r[0]), r[1:])
    )


def result(frame):
    return sorted(((*r[:5], tuple(r[5])) for r in map(tuple, frame.collect())), key=lambda r: (str(r[0]), r[1:]))


def grouped(seed, groups, size, dimensions, spread=0.2):
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = rng.normal(size=(groups, dimensions))
    return np.concatenate([c + spread * rng.normal(size=(size, dimensions)) for c in centres])


def test_against_brute_force(spark):
    x = grouped(1, 5, 60, 6)
    x[100:200] = x[0]  # a vector that a third of all rows share
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    for k, rounds in ((4, 10), (1, 3), (7, 0), (40, 2)):
        found = ptolemaic.cluster(frame, k=k, rounds=rounds, dimensions=6)
        assert result(found) == brute(rows, k, rounds, 6), (k, rounds)


def test_odd_rows(spark):
    rows = [
        (1, [0.5, 0.25], 1), (2, None, 1), (3, [0.1, None], 1), (4, [float("nan"), 0.0], 1),
        (5, [float("-inf"), 0.0], 1), (6, [0.5], 1), (7, [0.5, 0.25, 1.0], 1), (8, [], 1),
        (None, [0.5, 0.5], 1), (None, [-0.5, 0.5], 1), (9, [-0.0001, 0.0], 1), (10, [0.5, 0.25], 1),
    ]
    schema = "vec_id long, embedding array<double>, cluster int"
    frame = spark.createDataFrame(rows, schema)
    for k in (2, 5, 8):
        found = ptolemaic.cluster(frame, k=k, dimensions=2)
        assert result(found) == brute([r[:2] for r in rows], k, 10, 2)
    twice = spark.createDataFrame([rows[0], rows[0], rows[10]], schema)
    assert [r[:3] for r in result(ptolemaic.cluster(twice, k=2, dimensions=2))] == [(1, 1, 0), (1, 1, 0), (9, 0, 0)]
    empty = ptolemaic.cluster(frame.limit(0), dimensions=2)
    assert empty.collect() == [] and empty.columns[0] == "vec_id"


def test_components_beyond_small_numbers(spark):
    big = [1e6, -3e9, 2.5e15, 1e300, -1e300, 7.0, 0.0, 9e12]
    rows = [(i, [big[i % 8], big[(3 * i + 1) % 8]]) for i in range(24)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(ptolemaic.cluster(frame, k=3, rounds=4, dimensions=2)) == brute(rows, 3, 4, 2)


def test_bounds_hold_and_leave_distances_out():
    x = np.floor(1024 * grouped(2, 8, 300, 16, spread=0.1)).astype(np.int64)
    pivots = ptolemaic.Pivots(x[::300])
    centroids = x[::300] + 5
    away, from_pivots = pivots.distances(x), pivots.distances(centroids)
    exact = np.stack([ptolemaic.squares(x, c) for c in centroids], axis=1)
    assert (pivots.bounds(away, from_pivots) <= exact).all()
    number, best, measured = ptolemaic.nearest(x, away, centroids, from_pivots, pivots)
    assert (number == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert measured < 0.3 * exact.size


def test_bounds_are_never_above_distances_of_close_points():
    rng = np.random.Generator(np.random.PCG64(5))
    for scale in (1, 10, 10**6, 10**8):
        x = rng.integers(-scale, scale + 1, (400, 3))
        pivots = ptolemaic.Pivots(x[:6])
        exact = np.stack([ptolemaic.squares(x, c) for c in x[:40]], axis=1)
        assert (pivots.bounds(pivots.distances(x), pivots.distances(x[:40])) <= exact.astype(float)).all()
