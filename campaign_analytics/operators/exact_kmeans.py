"""Q23: k-means whose every step is an exact aggregation, so that its labels can be checked.

The customers' z-scores are rounded once to whole numbers of a fine grid.  Seeding and Lloyd's
steps then work on whole numbers alone: squared distances, sums and floored means do not
depend on the order of rows, so reruns, other layouts and plain SQL give the same labels.
Between steps only the k centres and their sums (k rows) reach the driver; each step is one
scan of the checkpointed points with partial aggregation per task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .profiles import DEFAULT_K, FEATURES, MAX_ITER, SHIFT_TOLERANCE, scaled_features

#: Grid steps of one standard deviation.  A z-score is at most the square root of the number of
#: customers, so squared distances fit 64 bits up to 10**10 customers.
GRID = 10_000
#: Points that may be seeds; a seeding step sums the distances that each of them would leave.
CANDIDATES = 12


def _point(feature: str) -> str:
    return f"point_{feature}"


POINT = [_point(f) for f in FEATURES]


def grid_points(inputs: DataFrame, stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``inputs`` with each feature's z-score in whole grid steps (half a step rounds up)."""
    scaled = scaled_features(inputs, stats, keep=True)
    points = [F.floor(F.col(f"z_{f}") * GRID + 0.5).cast("long").alias(_point(f)) for f in FEATURES]
    return scaled.select(*inputs.columns, *points)


def squared_distance(centre: list[int]) -> Column:
    parts = [(F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(POINT, centre)]
    return reduce(lambda a, b: a + b, parts)


def _nearest(centres: list[list[int]]) -> tuple[Column, Column]:
    """Number of the nearest centre (ties: the smaller number) and the squared distance from it."""
    away = [squared_distance(c) for c in centres]
    least = F.least(*away) if len(away) > 1 else away[0]
    number = F.lit(None).cast("int")
    for j in reversed(range(len(away))):
        number = F.when(away[j] == least, F.lit(j)).otherwise(number)
    return number, least


def seed_centres(points: DataFrame, k: int, id_col: str = "customer_id", candidates: int = CANDIDATES) -> list[list[int]]:
    """k times the candidate that leaves the least sum of squared distances from the nearest seed.

    Candidates are the points whose ids have the smallest md5, at most ``candidates`` of them, so
    an outlier is hardly one; every point counts in the sums.  Ties go to the smaller md5.  With
    fewer than k different points the last seeds repeat.
    """
    key = F.md5(F.col(id_col).cast("string").cast("binary"))
    drawn = [[r[c] for c in POINT] for r in points.orderBy(key, id_col).limit(candidates).collect()]
    seeds: list[list[int]] = []
    for _ in range(k if drawn else 0):
        away = [squared_distance(c) for c in drawn]
        left = [F.least(_nearest(seeds)[1], d) for d in away] if seeds else away
        sums = points.agg(*[F.sum(d.cast("decimal(20,0)")) for d in left]).first()
        seeds.append(drawn[min(range(len(drawn)), key=lambda i: (sums[i], i))])
    return seeds


@dataclass
class Fit:
    """Centres in grid steps, the steps taken, and whether the stopping rule ended them."""

    centres: list[list[int]] = field(default_factory=list)
    steps: int = 0
    settled: bool = False


def lloyd(points: DataFrame, centres: list[list[int]], max_iter: int = MAX_ITER) -> Fit:
    """Move every centre to the floored mean of its points until the centres hardly move.

    An empty cluster keeps its centre.  The rule is the reference's: the squared shifts of all
    centres sum to at most ``SHIFT_TOLERANCE`` on z-scores.
    """
    fit = Fit(centres)
    while fit.centres and fit.steps < max_iter and not fit.settled:
        # decimals: a sum of whole numbers over any number of rows
        sums = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in POINT]
        labelled = points.select(_nearest(fit.centres)[0].alias("cluster"), *POINT)
        moved = [list(c) for c in fit.centres]
        for row in labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # at most k rows
            moved[row["cluster"]] = [int(row[c]) // row["n"] for c in POINT]
        shift = sum((a - b) ** 2 for old, new in zip(fit.centres, moved) for a, b in zip(old, new))
        fit = Fit(moved, fit.steps + 1, shift <= SHIFT_TOLERANCE * GRID * GRID)
    return fit


def fit_exact(inputs: DataFrame, k: int = DEFAULT_K, max_iter: int = MAX_ITER) -> tuple[Fit, DataFrame]:
    """The fit, and the checkpointed grid points it was made on.

    The inputs are computed once; every step and the labelling read the checkpoint.
    """
    ensure_checkpoint_dir(inputs.sparkSession)
    points = grid_points(inputs.checkpoint(eager=True))
    return lloyd(points, seed_centres(points, k), max_iter), points


def fit_clusters(inputs: DataFrame, k: int = DEFAULT_K, max_iter: int = MAX_ITER) -> DataFrame:
    """Q23: ``inputs`` with the ``cluster`` of each customer; the same labels at every run."""
    fit, points = fit_exact(inputs, k, max_iter)
    number = _nearest(fit.centres)[0] if fit.centres else F.lit(None).cast("int")
    return points.select(*inputs.columns, number.alias("cluster"))


def cluster_centres(inputs: DataFrame, k: int = DEFAULT_K, max_iter: int = MAX_ITER) -> DataFrame:
    """Per cluster: its customers, its centre in grid steps, and the squared distances summed over it."""
    fit, points = fit_exact(inputs, k, max_iter)
    spark = inputs.sparkSession
    rows = [(j, *c) for j, c in enumerate(fit.centres)]
    names = [c.replace("point_", "centre_") for c in POINT]
    centres = spark.createDataFrame(rows, ", ".join(["number int", *[f"{n} long" for n in names]]))
    if not rows:
        none = F.lit(0).cast("long")
        return centres.select(
            F.col("number").alias("cluster"), none.alias("customer_count"), *names, none.alias("inertia")
        )
    number, least = _nearest(fit.centres)
    sizes = points.select(number.alias("cluster"), least.alias("away")).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("away").cast("decimal(20,0)")).alias("total")
    )
    # k rows on either side
    joined = centres.join(F.broadcast(sizes), F.col("number") == F.col("cluster"), "left")
    return joined.select(
        F.col("number").alias("cluster"),
        F.coalesce("n", F.lit(0)).alias("customer_count"),
        *names,
        F.coalesce(F.col("total").cast("long"), F.lit(0)).alias("inertia"),
    )
