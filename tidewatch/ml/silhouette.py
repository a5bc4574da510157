"""Mean silhouette: of plain Euclidean distances, or of squared ones for large tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import block_pairs, with_blocks
from ..session import spread

BLOCK_SIZE = 512


def silhouette(points: DataFrame, block_size: int = BLOCK_SIZE, exact: bool = True) -> DataFrame:
    """One row, one value: the mean silhouette of (point, cluster) rows.

    Null when there is only one cluster. Each pair of blocks gives the summed
    distance of its points to each cluster; distances themselves stay inside
    the task. Equal points are merged with their number first.

    That is quadratic in the points. With ``exact=False`` the value is
    ``squared_silhouette``, of squared distances, which needs only the moments of
    each cluster and two passes over the points.
    """
    return _of_distances(points, block_size) if exact else squared_silhouette(points)


def squared_silhouette(points: DataFrame) -> DataFrame:
    """One row, one value: the mean silhouette of (point, cluster) rows by squared Euclidean distance.

    The squared distances of a point x to the n points of a cluster, whose sum
    is s and whose squared lengths add up to q, add up to n |x|^2 + q - 2 x.s, so
    a count, a vector and a number per cluster take the place of all pairs. Null
    when there is only one cluster; a point alone in its cluster scores 0.
    """
    squares = F.aggregate("point", F.lit(0.0), lambda total, x: total + x * x)
    sums = points.select("cluster", F.posexplode("point").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("sums"))
    sizes = points.groupBy("cluster").agg(F.count("*").cast("double").alias("n"), F.sum(squares).alias("squares"))
    # One row of as many entries as there are clusters.
    moments = sizes.join(sums, "cluster").agg(F.array_sort(F.collect_list(F.struct("cluster", "n", "squares", "sums"))))
    placed = points.select("cluster", "point", squares.alias("own_squares"), moments.scalar().alias("moments"))

    def total(m):
        products = F.aggregate(F.zip_with("point", m["sums"], lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
        return F.greatest(m["n"] * F.col("own_squares") + m["squares"] - 2 * products, F.lit(0.0))

    own = F.filter("moments", lambda m: m["cluster"] == F.col("cluster"))[0]
    others = F.filter("moments", lambda m: m["cluster"] != F.col("cluster"))
    inside = F.when(own["n"] > 1, total(own) / (own["n"] - 1))
    outside = F.array_min(F.transform(others, lambda m: total(m) / m["n"]))
    rated = placed.select("cluster", inside.alias("inside"), outside.alias("outside"))
    score = F.coalesce(F.try_divide(F.col("outside") - F.col("inside"), F.greatest("inside", "outside")), F.lit(0.0))
    return rated.agg(F.when(F.count("outside") > 0, F.avg(
        F.when(F.col("inside").isNull(), F.lit(0.0)).otherwise(score))).alias("squared_silhouette"))


def _of_distances(points: DataFrame, block_size: int) -> DataFrame:
    merged = points.groupBy("point", "cluster").agg(F.count("*").cast("double").alias("members"))
    pairs = block_pairs(with_blocks(merged, [], ["point", "cluster"], block_size))

    def distances(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = group
        blocks = pdf["block"].to_numpy()
        x = np.stack(pdf["point"].to_numpy())
        cluster = pdf["cluster"].to_numpy()
        members = pdf["members"].to_numpy()
        out = []
        for a, b in {(i, j), (j, i)}:
            left, right = np.flatnonzero(blocks == a), np.flatnonzero(blocks == b)
            if not len(left) or not len(right):
                continue
            labels = np.unique(cluster[right])
            squares = (x[left] ** 2).sum(1)[:, None] + (x[right] ** 2).sum(1) - 2 * x[left] @ x[right].T
            d = np.sqrt(np.maximum(squares, 0.0))
            if a == b:
                np.fill_diagonal(d, 0.0)
            sums = np.stack([d[:, cluster[right] == c] @ members[right][cluster[right] == c] for c in labels], axis=1)
            rows = np.repeat(left, len(labels))
            out.append(pd.DataFrame({
                "point": pdf["point"].to_numpy()[rows], "cluster": cluster[rows],
                "other": np.tile(labels, len(left)), "distance": sums.ravel(),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=["point", "cluster", "other", "distance"])

    summed = (
        spread(pairs, "i", "j").groupBy("i", "j")
        .applyInPandas(distances, "point array<double>, cluster int, other int, distance double")
        .groupBy("point", "cluster", "other").agg(F.sum("distance").alias("distance"))
    )
    sizes = merged.groupBy("cluster").agg(F.sum("members").alias("size"))
    mean = F.when(
        F.col("other") == F.col("cluster"), F.try_divide("distance", F.col("size") - 1)
    ).otherwise(F.col("distance") / F.col("size"))
    per_point = (
        summed.join(sizes.withColumnRenamed("cluster", "other"), "other")
        .groupBy("point", "cluster").agg(
            F.max(F.when(F.col("other") == F.col("cluster"), mean)).alias("inside"),
            F.min(F.when(F.col("other") != F.col("cluster"), mean)).alias("outside"),
        )
    )
    # A point alone in its cluster has no inside mean and scores 0.
    score = F.coalesce(
        F.try_divide(F.col("outside") - F.col("inside"), F.greatest("inside", "outside")), F.lit(0.0)
    )
    score = F.when(F.col("inside").isNull(), F.lit(0.0)).otherwise(score)
    weighted = per_point.join(merged, ["point", "cluster"])
    return weighted.agg(
        F.when(F.count_distinct("cluster") > 1, F.sum(score * F.col("members")) / F.sum("members")).alias("silhouette")
    )
