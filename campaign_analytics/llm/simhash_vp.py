"""Operator 4: near-duplicates by SimHash, linked exactly with vantage-point trees.

Equal fingerprints are grouped first, so copies cost one entry.  A tree of vantage points,
fitted on a bounded sample of distinct fingerprints, cuts Hamming space into shards: a node
sends fingerprints within its radius one way and all others the other way, and those whose
distance is within the link distance of the radius also to a third child, as a pair that the
radius parts has both members there (triangle inequality).  Each shard is searched the same
way in its task, down to small blocks that are compared whole.  A shard returns the edges of
a spanning forest, not its pairs; connected components follow by alternating star steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_utf8, free_names, id_and_text, importable_on_workers, materialise

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
SAMPLE = 65_536
SHARD_ROWS = 8192
BLOCK_ROWS = 512
_BITS_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; no words: 0."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)  # its bits are over half of one
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle_words + 1].tolist()
    ends = ends[shingle_words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BITS_AT_ONCE):
        part = hashes[at : at + _BITS_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    ones = np.flatnonzero(2 * counts > len(hashes))
    return sum(1 << int(b) for b in ones)


def _fingerprints(shingle_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = np.array([fingerprint(texts[i].as_py(), shingle_words) for i in range(len(texts))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(found.view(np.int64))],
                names=[*[c for c in batch.schema.names if c != "text"], "fp"],
            )

    return run


def with_fingerprints(rows: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``text`` replaced by ``fp``, the fingerprint's bits as a long."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(_fingerprints(shingle_words), T.StructType([*kept, T.StructField("fp", T.LongType())]))


def _distance(values: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ one)


def choose_vantage(values: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that part ``values`` most evenly among a few; None if none does."""
    best = None
    for at in np.linspace(0, len(values) - 1, 5).astype(int):
        point = values[at]
        distances = _distance(values, point)
        radius = int(np.median(distances))
        for r in (radius, radius - 1):
            inside = int((distances <= r).sum())
            if 0 < inside < len(values):
                uneven = max(inside, len(values) - inside)
                if best is None or uneven < best[0]:
                    best = (uneven, point, r)
    return best and (best[1], best[2])


def part(values: np.ndarray, point: np.uint64, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks: within the radius, beyond it, and near enough to it that a link may cross."""
    d = _distance(values, point).astype(np.int16)
    inside = d <= radius
    return inside, ~inside, (d > radius - reach) & (d <= radius + reach)


def shard_tree(sample: np.ndarray, scale: float, reach: int, shard_rows: int = SHARD_ROWS):
    """Nested (point, radius, inside, outside, across); None is a shard.

    ``scale`` is how many fingerprints a sampled one stands for.
    """
    if len(sample) * scale <= shard_rows or len(sample) < 32:
        return None
    chosen = choose_vantage(sample)
    if chosen is None:
        return None
    parts = part(sample, *chosen, reach)
    if max(int(p.sum()) for p in parts) == len(sample):
        return None
    return (*chosen, *[shard_tree(sample[p], scale, reach, shard_rows) for p in parts])


def route(tree, values: np.ndarray, reach: int, path: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, members) over all shards; a fingerprint goes to one shard and to those across."""
    if tree is None:
        if len(values):
            yield path, values
        return
    point, radius, *children = tree
    for i, (mask, child) in enumerate(zip(part(values, point, radius, reach), children)):
        yield from route(child, values[mask], reach, path * 3 + i)


class Forest:
    """Disjoint sets over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def linked(values: np.ndarray, reach: int, block: int = BLOCK_ROWS) -> Forest:
    """The sets of distinct fingerprints linked within ``reach`` bits, by a vantage-point search."""
    forest = Forest(len(values))
    todo = [np.arange(len(values))]
    while todo:
        at = todo.pop()
        if len(at) < 2:
            continue
        own = values[at]
        chosen = choose_vantage(own) if len(at) > block else None
        if chosen is not None:
            parts = part(own, *chosen, reach)
            if max(int(p.sum()) for p in parts) < len(at):
                todo.extend(at[p] for p in parts)
                continue
        for a in range(0, len(at), block):
            for b in range(a, len(at), block):
                near = np.bitwise_count(own[a : a + block, None] ^ own[None, b : b + block]) <= reach
                for i, j in zip(*np.nonzero(near)):
                    if a + i < b + j:
                        forest.join(int(at[a + i]), int(at[b + j]))
    return forest


def _route(tree, reach: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for shard, members in route(tree, values, reach):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(members), shard, np.int64)), pa.array(members.view(np.int64))],
                    names=["shard", "fp"],
                )

    return run


def _search(reach: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        values = np.unique(rows.column("fp").to_numpy()).view(np.uint64)
        forest = linked(values, reach)
        roots = np.array([forest.find(i) for i in range(len(values))], np.int64)
        own = np.flatnonzero(roots != np.arange(len(values)))
        signed = values.view(np.int64)
        return pa.table([pa.array(signed[own]), pa.array(signed[roots[own]])], names=["a", "b"])

    return run


def spanning_edges(fps: DataFrame, reach: int, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` whose components are those of all links."""
    n = fps.count()
    drawn = fps.filter(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(max(n, 1))) < sample).select("fp").limit(2 * sample)
    points = np.sort(drawn.toArrow().column("fp").to_numpy().astype(np.int64)).view(np.uint64)
    tree = shard_tree(points, n / max(len(points), 1), reach, shard_rows)
    shards = fps.select("fp").mapInArrow(_route(tree, reach), "shard long, fp long")
    return shards.groupBy("shard").applyInArrow(_search(reach), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node reachable.

    Alternating large-star and small-star steps; each is two aggregations over edges, and
    the number of rounds grows with the logarithm of the longest path.
    """
    high_low = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialise(high_low.filter("a <> b").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = materialise(small.filter("a <> b").distinct())
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new


def _linked_fingerprints(fingerprinted: DataFrame, max_bits: int, sample: int, shard_rows: int) -> DataFrame:
    """fp, root (smallest fingerprint reachable), component_id (smallest id of all rows reachable)."""
    fps = materialise(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(spanning_edges(fps, max_bits, sample, shard_rows))
    every = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    named = fps.join(every, F.col("fp") == F.col("node"), "left")
    own = named.filter("root is null").select("fp", F.col("fp").alias("root"), F.col("low").alias("component_id"))
    shared = named.filter("root is not null").select("fp", "root", "low")
    lowest = shared.groupBy("root").agg(F.min("low").alias("component_id"))
    return materialise(own.union(shared.join(lowest, "root").select("fp", "root", "component_id")))


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    sample: int = SAMPLE,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero, linked like any other.  Null ids: the rows
    link as others do; component_id is the smallest id that is not null, null if there is
    none.  Repeated rows share a component.  Empty table: no rows.  Other columns are not read.
    """
    rows = materialise(with_fingerprints(id_and_text(docs, id_col, text_col), shingle_words))
    named = _linked_fingerprints(rows, max_bits, sample, shard_rows).select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", hexed, "component_id")


def keep_one(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, all columns kept.

    If several rows have that id, the one of the smallest row hash stays, and of equal rows
    one.  Null ids come after all others.  Empty table: no rows.
    """
    importable_on_workers(docs.sparkSession)
    (mark,) = free_names(docs, "row_mark")
    by_hand = [F.to_json(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in docs.schema.fields]
    marked = docs.withColumn(mark, F.xxhash64(*by_hand))
    read = marked.select(F.col(id_col).alias("doc_id"), as_utf8(text_col).alias("text"), F.col(mark).alias("mark"))
    rows = materialise(with_fingerprints(read, shingle_words))
    named = _linked_fingerprints(rows, max_bits, SAMPLE, SHARD_ROWS).select("fp", "root")
    copies = rows.groupBy("fp", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies"))
    best = copies.join(named, "fp").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "copies")).alias("best")
    )
    renamed = {"doc_id": "best_id", "mark": "best_mark", "copies": "copies"}
    winners = materialise(best.select(*[F.col(f"best.{old}").alias(new) for old, new in renamed.items()]))
    same = marked[id_col].eqNullSafe(winners["best_id"]) & (marked[mark] == winners["best_mark"])
    kept = marked.join(winners.select("best_id", "best_mark"), same, "left_semi")
    if not winners.filter("copies > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, mark])
    return kept.select(*docs.columns)
