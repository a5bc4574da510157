"""Isolation forest (Liu, Ting, Zhou 2008) fitted and applied as Spark plans.

All trees grow together, level by level: one set of window aggregates per
level gives the number of rows and the range of every feature in every node
of every tree, and all nodes are split at once. Draws are MD5 numbers of (seed,
tree, node), rows are drawn by a hash of their key, and features are rounded to
``DIGITS``, so a forest does not depend on partitions or on the order of sums
behind its features, and SQL can grow the same one. Path lengths are added up as
whole billionths. Rows are scored in Arrow batches, all trees a level at a time.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, spread
from .quantile import exact_quantile

MAX_SAMPLES = 256
#: A row is a candidate for a tree with this many times the chance it needs.
OVERSAMPLING = 4
#: Decimal places of features, and of scores.
DIGITS = 6
SCORE_DIGITS = 9
#: Path lengths are counted in parts of this size.
UNIT = 10**9
#: Draws of rows are numbers below this prime.
PRIME = 2**31 - 1
#: Rows that are scored at once.
ROWS = 2048
EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, threshold double, path long"
_PASSED = "array<struct<node:int,feature:int,threshold:double,path:long>>"


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 2:
        return float(max(n - 1, 0))
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def number(text: str) -> int:
    """The first 52 bits of the text's MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def depth_limit(sample_size: int) -> int:
    return math.ceil(math.log2(max(sample_size, 2)))


def _point(features: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.round(F.col(c).cast("double"), DIGITS) for c in features])


@dataclass(frozen=True)
class IsolationForestModel:
    """Fitted trees: ``nodes`` is a stored table of at most n_trees * (2 * MAX_SAMPLES - 1) rows.

    The children of node k are 2 k + 1 and 2 k + 2; a leaf has feature -1 and its path in UNITs.
    """

    nodes: DataFrame
    features: tuple[str, ...]
    n_trees: int
    sample_size: int
    offset: float

    def _arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, threshold and path as (tree, node) arrays."""
        table = self.nodes.toArrow()
        at = tuple(table.column(c).to_numpy() for c in ("tree", "node"))
        shape = (self.n_trees, 2 ** (depth_limit(self.sample_size) + 1) - 1)
        out = np.full(shape, -1, "int32"), np.zeros(shape), np.zeros(shape, "int64")
        for array, name in zip(out, ("feature", "threshold", "path")):
            array[at] = table.column(name).to_numpy()
        return out

    def _samples_score(self) -> Column:
        """Negated anomaly score in (-1, 0)."""
        shared = self.nodes.sparkSession.sparkContext.broadcast(self._arrays())
        levels = depth_limit(self.sample_size)

        @F.pandas_udf("long")
        def units(points: pd.Series) -> pd.Series:
            feature, threshold, path = shared.value
            trees, out = np.arange(len(feature)), np.zeros(len(points), "int64")
            for start in range(0, len(points), ROWS):
                x = np.array(points.iloc[start:start + ROWS].tolist(), "float64")
                rows, at = np.arange(len(x))[:, None], np.zeros((len(x), len(trees)), "int64")
                # All trees at once, a level at a time; leaves keep their place.
                for _ in range(levels):
                    f = feature[trees, at]
                    at = np.where(f < 0, at, 2 * at + np.where(x[rows, f] <= threshold[trees, at], 1, 2))
                out[start:start + ROWS] = path[trees, at].sum(1)
            return pd.Series(out)

        expected = (average_path(self.sample_size) or 1.0) * self.n_trees * UNIT
        return F.round(-F.pow(F.lit(2.0), -units("forest_point") / F.lit(expected)), SCORE_DIGITS)

    def score(self, df: DataFrame, model_type: str | None = None) -> DataFrame:
        """Add iforest_score (below 0 is anomalous), iforest_pred and is_anomaly."""
        held = df.withColumn("forest_point", _point(self.features))
        above = F.round(self._samples_score() - F.lit(self.offset), 12) + F.lit(0.0)
        out = held.withColumn("iforest_score", above).drop("forest_point")
        odd = F.col("iforest_score") < 0
        out = out.withColumns({"iforest_pred": F.when(odd, -1).otherwise(1), "is_anomaly": odd})
        return out.withColumn("model_type", F.lit(model_type)) if model_type else out

    def save(self, spark: SparkSession, path: str) -> None:
        self.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = [(list(self.features), self.n_trees, self.sample_size, self.offset)]
        schema = "features array<string>, n_trees int, sample_size int, offset double"
        spark.createDataFrame(meta, schema).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForestModel:
        meta = spark.read.parquet(f"{path}/meta").first()
        nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes")
        return cls(nodes, tuple(meta.features), meta.n_trees, meta.sample_size, meta.offset)


@dataclass(frozen=True)
class IsolationForest:
    """Trees grown on rows that a hash of their key chooses."""

    n_trees: int = 300
    contamination: float = 0.01
    seed: int = 42

    def fit(self, df: DataFrame, features: list[str], row_key: list[str]) -> IsolationForestModel:
        """Fit on ``df``, whose rows ``row_key`` identifies.

        Rows are chosen by a hash of their key, so the trees do not depend on
        how the data is partitioned. A loose threshold thins the rows of each
        tree before the smallest ``MAX_SAMPLES`` draws are kept; if a tree runs
        short of rows, all are drawn from.
        """
        n = df.count()
        if n == 0:
            raise ValueError("training set is empty")
        sample = min(MAX_SAMPLES, n)
        rows = materialise(self._sampled(df, features, row_key, sample, OVERSAMPLING * sample / n), "forest-rows")
        drawn = rows.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") >= sample).count()
        if drawn < self.n_trees:
            # A tree got too few rows through the threshold; without it every tree has its smallest draws.
            rows = self._sampled(df, features, row_key, sample, 1.0)
        nodes = materialise(self._grown(rows, len(features), depth_limit(sample)), "forest-nodes")
        unplaced = IsolationForestModel(nodes, tuple(features), self.n_trees, sample, 0.0)
        scores = materialise(unplaced.score(df.select(*features)).select("iforest_score"), "forest-scores")
        offset = exact_quantile(scores, "iforest_score", self.contamination)
        return IsolationForestModel(nodes, tuple(features), self.n_trees, sample, offset)

    def _sampled(self, df: DataFrame, features: list[str], row_key: list[str], sample: int, share: float) -> DataFrame:
        """tree, point of the rows with the smallest draws of each tree."""
        key = F.concat_ws("|", F.lit(str(self.seed)), *[F.col(c).cast("string") for c in row_key])
        trees = range(self.n_trees)
        # A row's draw for a tree is an affine function, of the tree, of its one hash.
        lines = F.array(*[F.struct(
            F.lit(t).alias("tree"), F.lit(1 + number(f"{self.seed}|{t}|slope") % (PRIME - 1)).cast("long").alias("slope"),
            F.lit(number(f"{self.seed}|{t}|start") % PRIME).cast("long").alias("start")) for t in trees])
        drawn = df.select(*row_key, _point(features).alias("point"), (_number(key) % PRIME).alias("hash"))
        draws = F.transform(lines, lambda line: F.struct(
            line["tree"].alias("tree"), ((F.col("hash") * line["slope"] + line["start"]) % PRIME).alias("draw")))
        if share < 1:
            draws = F.filter(draws, lambda d: d["draw"] < F.lit(int(share * PRIME)))
        drawn = drawn.select(*row_key, "point", F.explode(draws).alias("draw")).select(*row_key, "point", "draw.tree", "draw.draw")
        order = Window.partitionBy("tree").orderBy("draw", *row_key)
        return drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).select("tree", "point")

    def _grown(self, rows: DataFrame, width: int, limit: int) -> DataFrame:
        """The nodes of all trees. A tree has at most MAX_SAMPLES rows, so its windows are bounded."""
        state = spread(rows, "tree").select(
            "tree", *[F.col("point")[k].alias(f"x{k}") for k in range(width)], F.lit(0).alias("node"), F.lit(False).alias("done"),
            F.array().cast(_PASSED).alias("passed"))
        points = [f"x{k}" for k in range(width)]
        for depth in range(limit + 1):
            here = Window.partitionBy("tree", "node")
            stats = {"n": F.count("*").over(here)}
            for x in points:
                stats |= {f"low_{x}": F.min(x).over(here), f"high_{x}": F.max(x).over(here)}
            ends = F.array(*[F.struct(
                F.lit(k).alias("feature"), F.col(f"low_{x}").alias("low"), F.col(f"high_{x}").alias("high"), F.col(x).alias("own"))
                for k, x in enumerate(points)])
            state = state.withColumns(stats).withColumn("varying", F.filter(ends, lambda e: e["low"] < e["high"]))
            many = F.size("varying")
            label = F.concat_ws("|", F.lit(str(self.seed)), F.col("tree").cast("string"), F.col("node").cast("string"))
            pick = F.get("varying", (_number(F.concat(label, F.lit("|feature"))) % many).cast("int"))
            state = state.withColumn("pick", F.when(~F.col("done") & (F.col("n") > 1) & (many > 0) & F.lit(depth < limit), pick))
            place = (_number(F.concat(label, F.lit("|threshold"))) + 0.5) / F.lit(float(2**52))
            between = F.col("pick.low") + place * (F.col("pick.high") - F.col("pick.low"))
            state = state.withColumn("threshold", F.when(between >= F.col("pick.high"), F.col("pick.low")).otherwise(between))
            n = F.col("n")
            rest = F.when(n <= 2, (n - 1).cast("double")).otherwise(2 * (F.log(n - 1.0) + EULER_GAMMA) - 2 * (n - 1.0) / n)
            path = F.round((depth + rest) * UNIT).cast("long")
            split = F.col("pick").isNotNull()
            now = F.struct(
                F.col("node"), F.coalesce("pick.feature", F.lit(-1)).alias("feature"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
                F.when(split, F.lit(0).cast("long")).otherwise(path).alias("path"))
            state = state.select(
                "tree", *points,
                F.when(split, 2 * F.col("node") + F.when(F.col("pick.own") <= F.col("threshold"), 1).otherwise(2)).otherwise(F.col("node")).alias("node"),
                (~split).alias("done"), F.when(F.col("done"), F.col("passed")).otherwise(F.array_append("passed", now)).alias("passed"))
        return state.select("tree", F.explode("passed").alias("at")).select("tree", "at.*").dropDuplicates(["tree", "node"])
