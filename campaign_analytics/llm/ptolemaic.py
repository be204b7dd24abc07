"""Operator 11: exact k-means on integer vectors, with distances left out by Ptolemy's inequality.

Vectors become integers once, with their distances to a few fixed pivots beside them.  For a
vector x, a centroid c and two pivots p, q, Ptolemy's inequality bounds
|x c| >= | |x p| |c q| - |x q| |c p| | / |p q|, from cached numbers alone.  All roundings go
downwards, so a centroid whose bound is above the distance of another one is surely farther;
the centroids that are left are measured exactly in whole numbers.  Each round is one pass
over the stored vectors; only the centroids pass between rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable_on_workers, materialise

SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SALT = "3"
#: Pivots, the first of the starting centroids; and the others each is paired with, its farthest.
MOST_PIVOTS = 16
PARTNERS = 7
#: Cached distances are 32-bit floats: a relative error below 2**-23 each.
_SLACK = 2.0**-21
#: Whole numbers up to this size are subtracted, squared and summed without leaving 64 bits.
_SMALL = 1 << 27
_MOST = np.iinfo(np.int64).max
_CELLS = 1 << 20


def _largest(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` from one vector, as Python integers if large."""
    if max(_largest(x), _largest(c)) > _SMALL:
        x, c = x.astype(object), c.astype(object)
    away = x - c
    return (away * away).sum(axis=1)


def _lengths(found: np.ndarray) -> np.ndarray:
    return np.sqrt(found.astype(np.float64))


class Pivots:
    """Fixed pivots, and the pairs of them that bounds are taken from."""

    def __init__(self, vectors: np.ndarray, most: int = MOST_PIVOTS, partners: int = PARTNERS):
        kept = list(dict.fromkeys(tuple(int(a) for a in v) for v in vectors))[:most]
        self.vectors = np.array(kept, np.int64).reshape(len(kept), -1)
        between = self.distances(self.vectors).astype(np.float64)
        pairs = {
            (min(p, int(q)), max(p, int(q)))
            for p in range(len(kept))
            for q in np.argsort(-between[p], kind="stable")[:partners]
            if p != q
        }
        self.pairs = [(p, q, float(between[p, q]) * (1 + _SLACK)) for p, q in sorted(pairs)]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distances of the rows of ``x`` from every pivot, in 32 bits."""
        out = np.zeros((len(x), len(self.vectors)), np.float32)
        for i, p in enumerate(self.vectors):
            out[:, i] = _lengths(squares(x, p))
        return out

    def bounds(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Lower bounds of squared distances, from the pivot distances of vectors and of centroids."""
        x, c = x.astype(np.float64), c.astype(np.float64)
        best = np.zeros((len(x), len(c)))
        for p, q, apart in self.pairs:
            one, other = x[:, p, None] * c[:, q], x[:, q, None] * c[:, p]
            np.maximum(best, (np.abs(one - other) - _SLACK * (one + other)) / apart, out=best)
        return best * best * (1 - _SLACK)


def nearest(
    x: np.ndarray, away: np.ndarray, centroids: np.ndarray, from_pivots: np.ndarray, pivots: Pivots
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each row's nearest centroid, and distances measured.

    The centroid of the least bound is measured first, and then those whose bound is not above
    what was found; of equal distances the smaller number wins.
    """
    bounds = pivots.bounds(away, from_pivots)
    number = bounds.argmin(axis=1)
    best = np.zeros(len(x), object if max(_largest(x), _largest(centroids)) > _SMALL else np.int64)
    first, measured = number.copy(), len(x)
    for j in range(len(centroids)):
        rows = np.flatnonzero(first == j)
        best[rows] = squares(x[rows], centroids[j])
    for j in range(len(centroids)):
        rows = np.flatnonzero((bounds[:, j] <= best.astype(np.float64)) & (first != j))
        found = squares(x[rows], centroids[j])
        measured += len(rows)
        closer = ((found < best[rows]) | ((found == best[rows]) & (j < number[rows]))).astype(bool)
        best[rows[closer]], number[rows[closer]] = found[closer], j
    return number, best, measured


# --- stored vectors ----------------------------------------------------------------------


def _blob(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as one binary value each."""
    width = rows.shape[1] * rows.itemsize
    edges = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, edges, pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """The integer vectors of a binary column, each in 32 or in 64 bits a component."""
    values = column.to_pylist()
    if not values or all(len(v) == 4 * dimensions for v in values):
        return np.frombuffer(b"".join(values), "<i4").reshape(-1, dimensions).astype(np.int64)
    return np.stack([np.frombuffer(v, f"<i{len(v) // dimensions}").astype(np.int64) for v in values])


def _store(pivots: Pivots, dimensions: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, dimensions)
            away = _blob(pivots.distances(x))
            if _largest(x) < 1 << 31:
                blobs = _blob(x.astype("<i4"))
            else:
                blobs = pa.array([v.astype("<i4" if _largest(v) < 1 << 31 else "<i8").tobytes() for v in x])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), blobs, away], names=["vec_id", "v", "away"])

    return run


def _parts(
    batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: Pivots
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the stored vectors with their nearest centroids and distances."""
    from_pivots = pivots.distances(centroids)
    step = max(16, _CELLS // len(centroids))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            x = _matrix(batch.column("v"), centroids.shape[1])
            away = np.frombuffer(b"".join(batch.column("away").to_pylist()), "<f4").reshape(len(x), -1)
            number, best, _ = nearest(x, away, centroids, from_pivots, pivots)
            yield batch, x, number, best


def _sums(centroids: np.ndarray, pivots: Pivots) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, object)
        for _, x, number, _ in _parts(batches, centroids, pivots):
            exact = x if _largest(x) < 1 << 40 else x.astype(object)
            n += np.bincount(number, minlength=len(n))
            for j in np.unique(number):
                sums[j] += exact[number == j].sum(axis=0).astype(object)
        some = np.flatnonzero(n)
        if not len(some):
            return
        lists = pa.array([[Decimal(int(v)) for v in sums[j]] for j in some], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), lists], names=["cluster", "n", "sums"])

    return run


def _labels(centroids: np.ndarray, pivots: Pivots) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, number, best in _parts(batches, centroids, pivots):
            distance = np.minimum(best, _MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    return run


# --- the operator ------------------------------------------------------------------------

_RESULT = (
    "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
)


def kept_vectors(vectors: DataFrame, dimensions: int, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; vectors of another length, or with a null or
    non-finite component, are left out."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    whole = F.forall("x", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    rows = rows.filter(F.col("x").isNotNull() & (F.size("x") == dimensions) & whole)
    return rows.select("vec_id", F.transform("x", lambda a: F.floor(a * scale)).alias("v"))


def cluster(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    salt: str = SALT,
    most_pivots: int = MOST_PIVOTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared, exact), cluster_inertia, inertia, centroid.

    Kept are vectors of ``dimensions`` components, none null or not finite, as whole numbers
    floor(scale * x).  Centroids start as the k kept vectors whose ids have the smallest sha256 of
    ``salt:id``, in that order (null ids last, equal ids by vector); fewer vectors give fewer
    centroids.  ``rounds`` times every vector goes to the nearest centroid (ties: the smaller
    number) and each centroid that has vectors becomes the floor of their mean.  Repeated rows:
    a row each.  Empty table: no rows.  Components beyond 64 bits are the nearest whole number of
    64 bits, and so are distances and sums of distances.  Other columns are not read.
    """
    spark = vectors.sparkSession
    importable_on_workers(spark)
    rows = kept_vectors(vectors, dimensions, id_col, vector_col, scale)
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    # k rows: the parameter bounds them
    drawn = rows.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not drawn:
        return spark.createDataFrame([], _RESULT)
    centroids = np.array([r[0] for r in drawn], np.int64)
    pivots = Pivots(centroids, most_pivots)
    stored = materialise(rows.mapInArrow(_store(pivots, dimensions), "vec_id long, v binary, away binary"))
    for _ in range(rounds):
        parts = stored.mapInArrow(_sums(centroids, pivots), "cluster int, n long, sums array<decimal(38,0)>")
        cells = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
        # k * dimensions numbers
        found = cells.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()
        moved = centroids.copy()
        for j, place, n, total in found:
            moved[j, place] = int(total) // n
        if (moved == centroids).all():
            break
        centroids = moved
    labelled = materialise(stored.mapInArrow(_labels(centroids, pivots), "vec_id long, cluster int, distance long"))
    sums = labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()
    own = {j: int(total) for j, total in sums}
    inertia = min(sum(own.values()), _MOST)
    figures = [(j, min(own.get(j, 0), _MOST), inertia, [int(a) for a in c]) for j, c in enumerate(centroids)]
    schema = "number int, cluster_inertia long, inertia long, centroid array<long>"
    # one row per centroid
    per_cluster = F.broadcast(spark.createDataFrame(figures, schema))
    joined = labelled.join(per_cluster, F.col("cluster") == F.col("number"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
