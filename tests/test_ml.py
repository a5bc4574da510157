import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan, rows
from tidewatch.ml.forest import IsolationForest, IsolationForestModel, average_path
from tidewatch.ml.quantile import exact_quantile
from tidewatch.ml.regression import fit_regression, load_pipeline, predict, save_pipeline
from tidewatch.ml.silhouette import silhouette
from tidewatch.sources import load_models, save_models


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(3000, 2)))]
    data.append((9999, 30.0, -30.0))
    return spark.createDataFrame(data, "id int, x double, y double").cache()


def test_forest(spark, cloud, tmp_path):
    forest = IsolationForest(n_trees=60, contamination=0.02, seed=3)
    model = forest.fit(cloud, ["x", "y"], ["id"])
    scored = model.score(cloud, "m")
    assert scored.orderBy("iforest_score").first().id == 9999
    flagged = scored.where("is_anomaly").count()
    assert flagged == pytest.approx(0.02 * 3001, abs=2)
    again = forest.fit(cloud.repartition(7), ["x", "y"], ["id"])
    assert rows(model.nodes) == rows(again.nodes) and model.offset == again.offset
    assert rows(model.nodes) != rows(IsolationForest(60, 0.02, 4).fit(cloud, ["x", "y"], ["id"]).nodes)
    save_models(spark, model, again, str(tmp_path))
    loaded, _ = load_models(spark, str(tmp_path))
    assert rows(loaded.score(cloud, "m")) == rows(scored)
    sizes = [r["count"] for r in model.nodes.groupBy("tree").count().collect()]
    assert len(sizes) == 60 and max(sizes) < 512


def test_forest_on_few_and_equal_rows(spark):
    same = spark.range(5).select("id", F.lit(1.0).alias("x"))
    model = IsolationForest(10).fit(same, ["x"], ["id"])
    assert {r.is_anomaly for r in model.score(same).collect()} == {False}
    one = IsolationForest(10).fit(same.limit(1), ["x"], ["id"])
    assert one.score(same).count() == 5
    with pytest.raises(ValueError):
        IsolationForest(10).fit(same.limit(0), ["x"], ["id"])


def test_scores_equal_a_walk_by_hand(spark, cloud):
    """Each row's leaf, tree by tree, from the stored nodes."""
    model = IsolationForest(12, 0.02, 5).fit(cloud, ["x", "y"], ["id"])
    trees = {}
    for r in model.nodes.collect():
        trees.setdefault(r.tree, {})[r.node] = r
    for row in model.score(cloud).limit(50).collect():
        point, units = [round(row.x, 6), round(row.y, 6)], 0
        for nodes in trees.values():
            at = 0
            while nodes[at].feature >= 0:
                at = 2 * at + (1 if point[nodes[at].feature] <= nodes[at].threshold else 2)
            units += nodes[at].path
        raw = -(2 ** (-units / (average_path(256) * 12 * 1e9)))
        assert row.iforest_score == pytest.approx(raw - model.offset, abs=2e-9)


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert float(average_path(256)) == pytest.approx(2 * (math.log(255) + np.euler_gamma) - 2 * 255 / 256)


@pytest.mark.parametrize("limit", [10, 100, 100_000])
@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, limit, q):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [0.25] * 1500
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    assert exact_quantile(df, "v", q, limit) == pytest.approx(float(np.quantile(values, q)), abs=1e-12)


def test_quantile_of_two_heavy_values(spark):
    values = [0.0] * 2500 + [1.0] * 2500 + [i / 400 for i in range(1, 400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.1, 0.46, 0.463, 0.5, 0.537, 0.9):
        assert exact_quantile(df, "v", q, 10) == pytest.approx(float(np.quantile(values, q)), abs=1e-12)


def test_quantile_of_equal_values(spark):
    df = spark.range(5000).select(F.lit(2.5).alias("v"))
    assert exact_quantile(df, "v", 0.3, 10) == 2.5
    with pytest.raises(ValueError):
        exact_quantile(df.limit(0), "v", 0.3)


def exact_silhouette(points, labels):
    def mean(i, c):
        others = [j for j in range(len(points)) if labels[j] == c and j != i]
        return sum(math.dist(points[i], points[j]) for j in others) / len(others) if others else None
    scores = []
    for i in range(len(points)):
        a, b = mean(i, labels[i]), min(mean(i, c) for c in set(labels) if c != labels[i])
        scores.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return sum(scores) / len(scores)


@pytest.mark.parametrize("block_size", [1000, 7])
def test_silhouette(spark, block_size):
    rng = random.Random(2)
    points = [[rng.gauss(c * 2, 1), rng.gauss(0, 1), 1.0] for c in (0, 1, 2) for _ in range(15)] + [[9.0, 9.0, 9.0]]
    points += [points[0]] * 6
    labels = [c for c in (0, 1, 2) for _ in range(15)] + [3] + [0] * 6
    df = spark.createDataFrame([(str(i), p, c) for i, (p, c) in enumerate(zip(points, labels))], "k string, point array<double>, cluster int")
    assert silhouette(df, block_size).first()[0] == pytest.approx(exact_silhouette(points, labels))
    assert silhouette(df.where("cluster = 0")).first()[0] is None


def test_squared_silhouette(spark):
    """Against all pairs, with a cluster of one point and equal points; and in one pass without pairs."""
    rng = random.Random(3)
    points = [[rng.gauss(c * 2, 1), rng.gauss(0, 1)] for c in (0, 1, 2) for _ in range(15)] + [[9.0, 9.0]]
    points += [points[0]] * 6
    labels = [c for c in (0, 1, 2) for _ in range(15)] + [3] + [0] * 6

    def mean(i, c):
        others = [j for j in range(len(points)) if labels[j] == c and j != i]
        return sum(math.dist(points[i], points[j]) ** 2 for j in others) / len(others) if others else None

    scores = []
    for i in range(len(points)):
        a, b = mean(i, labels[i]), min(mean(i, c) for c in set(labels) if c != labels[i])
        scores.append(0.0 if a is None else (b - a) / max(a, b))
    df = spark.createDataFrame(list(zip(points, labels)), "point array<double>, cluster int")
    got = silhouette(df, exact=False)
    assert got.columns == ["squared_silhouette"] and got.first()[0] == pytest.approx(sum(scores) / len(scores))
    assert "Python" not in plan(got) and "applyIn" not in plan(got)
    assert silhouette(df.where("cluster = 0"), exact=False).first()[0] is None
    assert silhouette(df.limit(0), exact=False).first()[0] is None


def test_regression(spark, tmp_path):
    rng = random.Random(1)
    data = [(rng.random(), rng.random()) for _ in range(100)]
    df = spark.createDataFrame([(a, b, 3 * a - 2 * b + 1) for a, b in data], "x0 double, x1 double, y double")
    model = fit_regression(df, ["x0", "x1"], "y")
    save_pipeline(model, str(tmp_path / "m"))
    got = predict(load_pipeline(str(tmp_path / "m")), df)
    assert got.columns == ["x0", "x1", "y", "prediction"]
    assert got.select(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 1e-8
