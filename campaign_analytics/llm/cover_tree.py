"""Operator 1: exact top-k inner-product search with two cover trees.

Data and queries are dealt to cells around pivots from a bounded sample; a large cell is
split by hash.  In each shard a cover tree is built over the data and one over the queries
that reach it, and both are descended together: a pair of nodes is dropped if the largest
inner product their centres and covering radii allow is below the worst kth score of the
query group.  A query first searches a shard of its own cell, and then only those cells whose
covering radius leaves room for a score not below its kth.  Equal vectors beyond k + 1 of
the smallest ids can be in no result and are left out before anything is dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import importable_on_workers, materialise

SCALE = 1024
K = 10
SHARD_ROWS = 8192
#: Queries that one task searches a shard for at a time.
QUERY_ROWS = 8192
#: Shards with more queries, up to which their list is sent to all tasks.
_BROADCAST_SHARDS = 100_000
SAMPLE = 8192
MOST_PIVOTS = 1024
LEAF = 48
_LOW = np.iinfo(np.int64).min
_FAR = np.iinfo(np.int64).max
_SALTS = 1 << 32  # shard = cell * _SALTS + part of the cell


class Node:
    __slots__ = ("rows", "centre", "radius", "most", "children")

    def __init__(self, rows: np.ndarray, centre: np.ndarray, radius: float, most: float, children: list[Node]):
        self.rows, self.centre, self.radius, self.most, self.children = rows, centre, radius, most, children


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree over the rows of ``x``.

    A node covers its rows by a ball around one of them.  Its children cover them by balls of
    half that radius whose centres are farther apart than that; the first child keeps the
    node's centre.  Rows that are their ball alone share one child.
    """
    norms = np.sqrt((x * x).sum(axis=1))

    def node(rows: np.ndarray, centre: int) -> Node:
        away = np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1))
        radius = float(away.max())
        made = Node(rows, x[centre], radius, float(norms[rows].max()), [])
        if len(rows) <= leaf or radius == 0:
            return made
        rest, alone, at = rows, [], centre
        while len(rest):
            near = ((x[rest] - x[at]) ** 2).sum(axis=1) <= (radius / 2) ** 2
            own = rest[near]
            if len(own) == 1:
                alone.append(own[0])
            else:
                made.children.append(node(own, at))
            rest = rest[~near]
            at = rest[0] if len(rest) else at
        for i in range(0, len(alone), leaf):
            own = np.array(alone[i : i + leaf])
            away = np.sqrt(((x[own] - x[centre]) ** 2).sum(axis=1))
            made.children.append(Node(own, x[centre], float(away.max()), float(norms[own].max()), []))
        return made

    return node(np.arange(len(x)), 0)


def most_product(q: np.ndarray, q_radius, q_most, r: np.ndarray, r_radius, r_most) -> np.ndarray:
    """The largest inner product of a point of ball q and one of ball r, rounded up.

    The lesser of two bounds: by Cauchy-Schwarz around the centres, and from the least
    distance and the largest norms.
    """
    between = q @ r.T
    q2, r2 = (q * q).sum(axis=-1), (r * r).sum(axis=-1)
    q2 = q2[..., None] if between.ndim > q2.ndim and q2.ndim else q2
    by_centre = between + np.sqrt(q2) * r_radius + np.sqrt(r2) * q_radius + q_radius * r_radius
    gap = np.maximum(0.0, np.sqrt(np.maximum(0.0, q2 + r2 - 2 * between)) - q_radius - r_radius)
    by_distance = (q_most * q_most + r_most * r_most - gap * gap) / 2
    bound = np.minimum(by_centre, by_distance)
    return bound + 1e-9 * (np.abs(bound) + q_most * r_most) + 1e-6


def exact_products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where every partial sum is a whole number it holds."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(q.shape[1], 1)
    if top < 2.0**53:
        return np.rint(q.astype(np.float64) @ r.T.astype(np.float64)).astype(np.int64)
    return q @ r.T


class Search:
    """The k best rows of ``data`` for each row of ``queries``, ties to smaller ids."""

    def __init__(
        self, queries: np.ndarray, own_ids: np.ndarray, kth: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int
    ):
        self.queries, self.own_ids, self.data, self.ids, self.k = queries, own_ids, data, ids, k
        self.scores = np.full((len(queries), k), _LOW, np.int64)
        self.found = np.full((len(queries), k), _FAR, np.int64)
        self.kth = kth  # below this no row can be in a result
        self.pairs = 0

    def run(self) -> None:
        q, r = cover_tree(self.queries.astype(np.float64)), cover_tree(self.data.astype(np.float64))
        todo = [(q, r)]
        while todo:
            q, r = todo.pop()
            if self._bounds(q, [r])[0] < self.kth[q.rows].min():
                continue
            if not q.children and not r.children:
                self._compare(q.rows, r.rows)
            elif r.children and (not q.children or r.radius >= q.radius):
                bounds = self._bounds(q, r.children)
                worst = self.kth[q.rows].min()
                todo.extend((q, r.children[i]) for i in np.argsort(bounds) if bounds[i] >= worst)
            else:
                todo.extend((child, r) for child in q.children)

    @staticmethod
    def _bounds(q: Node, others: list[Node]) -> np.ndarray:
        centres = np.stack([o.centre for o in others])
        radii, most = np.array([o.radius for o in others]), np.array([o.most for o in others])
        return most_product(q.centre, q.radius, q.most, centres, radii, most)

    def _compare(self, q: np.ndarray, r: np.ndarray) -> None:
        self.pairs += len(q) * len(r)
        scores = exact_products(self.queries[q], self.data[r])
        ids = np.broadcast_to(self.ids[r], scores.shape).copy()
        for i, j in zip(*np.nonzero(ids == self.own_ids[q][:, None])):
            if np.array_equal(self.queries[q[i]], self.data[r[j]]):
                scores[i, j], ids[i, j] = _LOW, _FAR
        scores = np.concatenate([self.scores[q], scores], axis=1)
        ids = np.concatenate([self.found[q], ids], axis=1)
        best = np.lexsort((ids, ~scores), axis=-1)[:, : self.k]
        self.scores[q] = np.take_along_axis(scores, best, 1)
        self.found[q] = np.take_along_axis(ids, best, 1)
        self.kth[q] = np.maximum(self.kth[q], self.scores[q][:, -1])


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """List values as rows, zeros after the shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows far from each other, farthest first."""
    if not len(sample):
        return np.zeros((1, 1))
    x = sample.astype(np.float64)
    chosen, away = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and away.max() > 0:
        at = int(away.argmax())
        chosen.append(at)
        away = np.minimum(away, ((x - x[at]) ** 2).sum(axis=1))
    return x[chosen]


def _cells(pivots: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), pivots.shape[1]).astype(np.float64)
            p = _widened(pivots, x.shape[1])
            squares = (x * x).sum(axis=1)
            cell = ((p * p).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
            away = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int64)), pa.array(away), pa.array(np.sqrt(squares))],
                names=[*batch.schema.names, "cell", "away", "norm"],
            )

    return run


def _search_shard(k: int) -> Callable:
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and data.num_rows:
            q, d = matrix(queries.column("v")), matrix(data.column("v"))
            width = max(q.shape[1], d.shape[1], 1)
            kth = queries.column("kth").to_numpy().copy()
            search = Search(
                _widened(q, width),
                queries.column("vec_id").to_numpy(),
                kth,
                _widened(d, width),
                data.column("vec_id").to_numpy(),
                k,
            )
            search.run()
            at, place = np.nonzero(search.found != _FAR)
            out = [
                queries.column("query_key").take(pa.array(at)),
                queries.column("vec_id").take(pa.array(at)),
                pa.array(search.found[at, place]),
                pa.array(search.scores[at, place]),
            ]
        names = ["query_key", "query_id", "vec_id", "score"]
        return pa.table(out or [pa.array([], pa.int64())] * 4, names=names)

    return run


def _route(pivots: np.ndarray, radii: np.ndarray, most: np.ndarray, parts: np.ndarray) -> Callable:
    """Every shard that may hold a score not below a query's kth, but for the one searched before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), pivots.shape[1]).astype(np.float64)
            home, kth = batch.column("cell").to_numpy(), batch.column("kth").to_numpy()
            norm = np.sqrt((x * x).sum(axis=1))[:, None]
            bounds = most_product(x, 0.0, norm, _widened(pivots, x.shape[1]), radii, most)
            at, cell = np.nonzero((bounds >= kth[:, None]) & (parts > 0))
            rows = np.repeat(at, parts[cell])
            first = np.repeat(np.cumsum(parts[cell]) - parts[cell], parts[cell])
            part = np.arange(len(rows)) - first
            shard = np.repeat(cell, parts[cell]) * _SALTS + part
            new = shard != home[rows] * _SALTS
            for i in range(0, int(new.sum()), 4096):  # a query may go to many shards
                some = np.flatnonzero(new)[i : i + 4096]
                kept = [batch.column(c).take(pa.array(rows[some])) for c in ("query_key", "vec_id", "v", "kth")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(shard[some])], names=["query_key", "vec_id", "v", "kth", "shard"]
                )

    return run


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component x as a double; other vectors are left out."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull()
    )
    rows = rows.filter(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


_RESULTS = "query_key long, query_id long, vec_id long, score long"


def _search(queries: DataFrame, sharded: DataFrame, k: int, query_rows: int) -> DataFrame:
    """The k best of each query's shards.  ``queries`` has query_key, vec_id, v, kth, shard.

    A shard with more than ``query_rows`` queries is searched by several tasks, each for a
    part of them, so neither side of a task grows with the table.
    """
    queries = materialise(queries)
    sizes = queries.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > query_rows)
    busy = materialise(sizes.select(F.col("shard").alias("busy_shard"), F.ceil(F.col("n") / query_rows).alias("blocks")))
    n = busy.count()
    if not n:
        return queries.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(_search_shard(k), _RESULTS)
    busy = F.broadcast(busy) if n <= _BROADCAST_SHARDS else busy
    blocks = F.coalesce("blocks", F.lit(1))
    left = queries.join(busy, F.col("shard") == F.col("busy_shard"), "left")
    left = left.withColumn("block", F.pmod(F.xxhash64("query_key"), blocks)).select(*queries.columns, "block")
    right = sharded.join(busy, F.col("shard") == F.col("busy_shard"), "left")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    right = right.select(*sharded.columns, "block")
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search_shard(k), _RESULTS)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    sample: int = SAMPLE,
    most_pivots: int = MOST_PIVOTS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vec_id``.  Candidates are all rows but the query's own;
    ties go to the smaller id, and fewer than k candidates give fewer rows.  Rows without an
    id, and vectors that are null or hold a null or a component that is not finite, take no
    part.  Vectors of different lengths are compared as if zeros followed the shorter one.
    Rows equal in id and vector are one row; rows of one id and different vectors are rows of
    their own.  Scores beyond 64 bits wrap.  Empty table: no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    importable_on_workers(spark)
    rows = integer_vectors(vectors, id_col, vector_col)
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("place", rank).filter(F.col("place") <= k + 1).drop("place").distinct()
    data = materialise(few)
    n = data.count()
    in_sample = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(n, 1))) < sample
    drawn = data.filter(in_sample).select("v").limit(2 * sample).toArrow()
    pivots = choose_pivots(matrix(drawn.column("v")), min(most_pivots, -(-n // (shard_rows // 4)) + 1))
    celled = materialise(
        data.mapInArrow(_cells(pivots), "vec_id long, v array<long>, cell long, away double, norm double")
    )
    radii, most, parts = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in celled.groupBy("cell").agg(F.count(F.lit(1)), F.max("away"), F.max("norm")).collect():
        parts[r[0]], radii[r[0]], most[r[0]] = -(-r[1] // shard_rows), r[2], r[3]
    radii, most = radii * (1 + 1e-12), most * (1 + 1e-12)
    of_cell = F.element_at(F.array(*[F.lit(int(p)) for p in np.maximum(parts, 1)]), (F.col("cell") + 1).cast("int"))
    part = F.pmod(F.xxhash64("vec_id", F.lit(2)), of_cell)
    sharded = celled.select("vec_id", "v", (F.col("cell") * _SALTS + part).alias("shard"))
    queries = rows.filter(is_query).distinct().withColumn("query_key", F.xxhash64("vec_id", "v"))
    queries = materialise(
        queries.mapInArrow(
            _cells(pivots), "vec_id long, v array<long>, query_key long, cell long, away double, norm double"
        )
    )
    at_home = queries.select(
        "query_key", "vec_id", "v", F.lit(_LOW).alias("kth"), (F.col("cell") * _SALTS).alias("shard")
    )
    first = materialise(_search(at_home, sharded, k, query_rows))
    worst = first.groupBy("query_key").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    bounded = queries.join(worst, "query_key", "left").withColumn("kth", F.coalesce("kth", F.lit(_LOW)))
    routed = bounded.select("query_key", "vec_id", "v", "cell", "kth").mapInArrow(
        _route(pivots, radii, most, parts), "query_key long, vec_id long, v array<long>, kth long, shard long"
    )
    others = _search(routed, sharded, k, query_rows)
    order = Window.partitionBy("query_key").orderBy(F.col("score").desc(), "vec_id")
    best = first.union(others).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
