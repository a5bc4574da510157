"""Command profiles by role and hour of week, and clusters of commands."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import purity
from ..functions.scores import ratio_or_zero
from ..ml.kmeans import k_means
from ..ml.silhouette import silhouette
from ..session import materialise
from .heatmap import hour_counts, role_events

ROLES = ["human", "functional"]


@dataclass(frozen=True)
class Clustering:
    """Clustered rows plus one row of statistics."""

    rows: DataFrame
    stats: DataFrame


def role_counts(log: DataFrame) -> DataFrame:
    """Events per command and role; commands of other roles keep zeros."""
    return log.where(F.col("command").isNotNull() & F.col("account_type").isNotNull()).groupBy("command").agg(*[
        F.count_if(F.col("account_type") == r).alias(f"{r}_freq") for r in ROLES
    ])


def role_proportions(log: DataFrame) -> DataFrame:
    total = F.col("human_freq") + F.col("functional_freq")
    return role_counts(log).select(
        "command", *[ratio_or_zero(F.col(f"{r}_freq"), total).alias(f"{r}_prop") for r in ROLES]
    )


def hour_profile(log: DataFrame, key: str = "command") -> DataFrame:
    """Share of each key's events in each of the 168 hours; rows (key, hour_of_week, share).

    Events without a readable time are not part of any hour.
    """
    counts = hour_counts(role_events(log).where(F.col(key).isNotNull()), [key])
    share = ratio_or_zero(F.col("n"), F.sum("n").over(Window.partitionBy(key)))
    return counts.select(key, "hour_of_week", share.alias("share"))


def _vectors(profile: DataFrame, key: str = "command") -> DataFrame:
    """One vector of 168 shares per key."""
    cell = F.struct("hour_of_week", "share")
    ordered = F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["share"])
    return profile.groupBy(key).agg(array_to_vector(ordered).alias("raw"))


def best_split(points: DataFrame, axis: str, coordinates: list[str]) -> DataFrame:
    """Add ``cluster`` 0 or 1: the cut of ``axis`` that leaves the least squared distances to the two means.

    The exact two-means clustering of points that lie in order on a line, so
    the result depends on nothing but the points. A cut's gain needs only sums
    of the points before it; they are added up over 4,096 parts of the axis
    (from -1 to 1) and then within each part. Of equal cuts the lowest is taken;
    points that are all at one place are cluster 0.
    """
    part = F.floor((F.col(axis) + 1) * 2048)
    values = points.groupBy(axis).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in coordinates]).withColumn("part", part)
    names = ["n", *coordinates]
    parts = values.groupBy("part").agg(*[F.sum(c).alias(c) for c in names])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = parts.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in names],
                          *[F.sum(c).over(everything).alias(f"{c}_all") for c in names])
    within = Window.partitionBy("part").orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = values.join(starts, "part").select(axis, *[(F.sum(c).over(within) + F.col(f"{c}_before")).alias(f"{c}_left") for c in names],
                                              *[f"{c}_all" for c in names])
    left = sum(F.col(f"{c}_left") * F.col(f"{c}_left") for c in coordinates) / F.col("n_left")
    rest = [F.col(f"{c}_all") - F.col(f"{c}_left") for c in names]
    right = sum(r * r for r in rest[1:]) / rest[0]
    gains = cuts.where(F.col("n_left") < F.col("n_all")).select(axis, F.round(left + right, 9).alias("gain"))
    best = gains.agg(F.min_by(axis, F.struct(-F.col("gain"), axis)).alias("cut"))
    return points.withColumn("cluster", F.coalesce((F.col(axis) > best.scalar()).cast("int"), F.lit(0)))


def role_clusters(log: DataFrame, exact: bool = True) -> Clustering:
    """Two clusters of commands by role proportions, with purity and statistics; ``silhouette`` is of squared distances if not ``exact``."""
    props = materialise(role_proportions(log), "role-proportions")
    lean = props.withColumn("lean", F.col("human_prop") - F.col("functional_prop"))
    rows = best_split(lean, "lean", [f"{r}_prop" for r in ROLES]).drop("lean")
    rows = materialise(rows.withColumn("purity", purity("human_prop", "functional_prop")), "role-clusters")
    centres = cluster_stats(rows)
    stats = silhouette(rows.select(F.array(*[f"{r}_prop" for r in ROLES]).alias("point"), "cluster"), exact=exact)
    distance = F.sqrt(sum(
        F.pow(F.col(f"{r}_0") - F.col(f"{r}_1"), F.lit(2.0)) for r in ROLES
    ))
    wide = centres.agg(*[
        F.max(F.when(F.col("cluster") == c, F.col(f"mean_{v}"))).alias(f"{n}_{c}")
        for c in (0, 1) for v, n in (("human_prop", "human"), ("functional_prop", "functional"), ("purity", "purity"))
    ]).select(
        distance.alias("centroid_distance"),
        F.col("purity_0").alias("mean_purity_cluster0"), F.col("purity_1").alias("mean_purity_cluster1"),
    )
    return Clustering(rows, wide.withColumn("silhouette", stats.scalar()))


def cluster_stats(rows: DataFrame) -> DataFrame:
    """Mean proportions and purity per cluster."""
    return rows.groupBy("cluster").agg(*[
        F.avg(c).alias(f"mean_{c}") for c in ("human_prop", "functional_prop", "purity")
    ])


def purity_tables(rows: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` purest commands of each cluster.

    The rank is taken in parts first, so no cluster is ordered in one task.
    """
    best = Window.partitionBy("cluster").orderBy(F.desc("purity"), "command")
    part = Window.partitionBy("cluster", "part").orderBy(F.desc("purity"), "command")
    shortlist = (
        rows.withColumn("part", F.pmod(F.xxhash64("command"), F.lit(256)))
        .withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= n).drop("part", "rank")
    )
    return (
        shortlist.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
        .select("cluster", "rank", "command", "human_prop", "functional_prop", "purity")
    )


def hour_clusters(log: DataFrame, k: int = 3, pca: bool = True, exact: bool = True) -> Clustering:
    """Clusters of commands by standardised hour-of-week shares; ``exact=False`` takes the silhouette of squared distances."""
    vectors = materialise(_vectors(hour_profile(log)), "hour-vectors")
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(vectors).transform(vectors)
    # Spark divides by the sample deviation; this factor gives the population one.
    n = vectors.count()
    factor = F.lit(math.sqrt(n / max(n - 1, 1)))
    rows = scaled.withColumn(
        "features", array_to_vector(F.transform(vector_to_array("scaled"), lambda x: x * factor))
    ).drop("raw", "scaled")
    rows = materialise(rows.withColumn("point", vector_to_array("features")), "hour-points")
    rows = materialise(k_means(rows, k, "command"), "hour-clusters")
    stats = silhouette(rows.select("point", "cluster"), exact=exact)
    rows = rows.drop("point")
    if pca:
        rows = _two_components(rows)
    return Clustering(rows.drop("features"), stats)


def _two_components(rows: DataFrame) -> DataFrame:
    """Add pc1 and pc2; each component points to its largest loading."""
    model = PCA(k=2, inputCol="features", outputCol="pcs").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if abs(c.max()) >= abs(c.min()) else -1.0 for c in loadings.T]
    coords = vector_to_array("pcs")
    out = model.transform(rows)
    return out.withColumns({f"pc{i + 1}": coords[i] * F.lit(s) for i, s in enumerate(signs)}).drop("pcs")


def compare(real: DataFrame, other: DataFrame, k: int = 3, n: int = 8, exact: bool = True) -> dict[str, DataFrame]:
    """Five metrics of two command logs side by side, and the tables behind them.

    The silhouettes are of squared distances, without pairs of commands, if not ``exact``.
    """
    tables: dict[str, DataFrame] = {}
    summary = None
    for side, log in (("real", real), ("synthetic", other)):
        roles, hours = role_clusters(log, exact), hour_clusters(log, k, pca=False, exact=exact)
        tables |= {
            f"{side}_props": roles.rows, f"{side}_hours": hours.rows,
            f"{side}_purity": purity_tables(roles.rows, n),
        }
        wide = roles.stats.select(
            F.col("silhouette").alias("role_silhouette"),
            F.col("centroid_distance").alias("role_centroid_distance"),
            F.col("mean_purity_cluster0").alias("role_mean_purity_cluster0"),
            F.col("mean_purity_cluster1").alias("role_mean_purity_cluster1"),
        ).withColumn("hour_of_week_silhouette", hours.stats.scalar())
        long = wide.unpivot([], wide.columns, "metric", side)
        summary = long if summary is None else summary.join(long, "metric")
    return {"summary": summary, **tables}
