"""K-means whose result depends on the points only."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Rounds at most, the digits that sums are rounded to, and the room that bounds leave for rounding.
MOST_ROUNDS, DIGITS, ROOM = 50, 9, 1e-6

Centres = list[list[float]]


def squared_distance(point: str, centre: list[float]) -> Column:
    """Squared distance, added up in the order of the coordinates."""
    gaps = F.zip_with(point, F.array(*map(F.lit, centre)), lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x)


def _gaps(point: str, centres: Centres) -> Column:
    """Centres from the nearest on, the first among equals: (gap, cluster)."""
    return F.array_sort(F.array(*[
        F.struct(F.round(squared_distance(point, c), DIGITS).alias("gap"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]))


def assigned(points: DataFrame, point: str, centres: Centres) -> DataFrame:
    """Add ``cluster``, the number of the nearest centre, the first among equals."""
    return points.withColumn("cluster", _gaps(point, centres)[0]["cluster"])


def first_centres(points: DataFrame, k: int, key: str, point: str) -> Centres:
    """The point of the lowest key, then ``k`` - 1 times the point farthest from its nearest centre, the lowest key among equals."""
    centres = [list(points.orderBy(key).first()[point])]
    while len(centres) < k:
        nearest = F.round(F.least(*[squared_distance(point, c) for c in centres], F.lit(float("inf"))), DIGITS)
        far = points.select(point, key, nearest.alias("gap")).orderBy(F.desc("gap"), key).first()
        if far["gap"] == 0:
            break
        centres.append(list(far[point]))
    return centres


def _bounded(rows: DataFrame, point: str, centres: Centres, moves: list[float] | None) -> DataFrame:
    """Rows with cluster, the cluster before (``was``), and bounds: the own centre is at most ``near`` away, any other at least ``rest``.

    ``moves`` says how far each centre has moved (none: nothing is known). A point whose
    bounds still lie apart keeps its cluster without any distance being computed.
    """
    found = _gaps(point, centres)
    fresh = F.struct(
        found[0]["cluster"].alias("cluster"), F.sqrt(found[0]["gap"]).alias("near"),
        (F.sqrt(found[1]["gap"]) if len(centres) > 1 else F.lit(float("inf"))).alias("rest"))
    if moves is None:
        return rows.withColumn("now", fresh).select(*rows.columns, F.lit(None).cast("int").alias("was"), "now.*")
    near = F.col("near") + F.get(F.array(*map(F.lit, moves)), F.col("cluster"))
    rest = F.col("rest") - max(moves)
    kept = F.struct("cluster", near.alias("near"), rest.alias("rest"))
    moved = rows.withColumn("now", F.when(near + ROOM < rest, kept).otherwise(fresh)).withColumn("was", F.col("cluster"))
    return moved.select(*[c for c in rows.columns if c not in ("cluster", "near", "rest", "was")], "was", "now.*")


def k_means(points: DataFrame, k: int, key: str, point: str = "point", rounds: int = MOST_ROUNDS) -> DataFrame:
    """Add ``cluster`` to stored ``points``: Lloyd's rounds from ``first_centres``, numbered by their centres.

    Bounds on the distances to centres are kept per point and widened by what
    the centres moved (triangle inequality), so a round computes distances
    only for points that can change sides, and only those that did are added
    up, in one aggregation. Means are rounded to ``DIGITS``, so that the order of
    sums, and with it the partitioning, does not matter. Rounds end when no
    point changes sides. Only centres and sums per cluster reach the driver.
    """
    centres = first_centres(points, k, key, point)
    state = materialise(_bounded(points.select(key, point), point, centres, None), "means-state")
    vector = array_to_vector(point)
    sums, sizes = [[0.0] * len(c) for c in centres], [0] * len(centres)
    for _ in range(rounds):
        changes = state.where(~F.col("was").eqNullSafe(F.col("cluster"))).groupBy("was", "cluster").agg(
            F.count("*").alias("n"), Summarizer.sum(vector).alias("sum")).collect()
        if not changes:
            break
        for r in sorted(changes, key=lambda r: (r["was"] is not None, r["was"], r["cluster"])):
            for side, sign in ((r["cluster"], 1), (r["was"], -1)):
                if side is not None:
                    sizes[side] += sign * r["n"]
                    sums[side] = [a + sign * b for a, b in zip(sums[side], r["sum"].toArray().tolist())]
        after = [[round(x / n, DIGITS) for x in s] if n else c for s, n, c in zip(sums, sizes, centres)]
        moves = [math.dist(a, b) for a, b in zip(centres, after)]
        if not any(moves):
            break
        centres = after
        state = materialise(_bounded(state, point, centres, moves), "means-state")
    return assigned(points, point, sorted(centres))
