import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewatch.operators import graph as gr
from tidewatch.operators.blocks import block_pairs, block_triples

SIM = "user string, user_type string, remote_network string, device_ip_address string, cmd_keywords string, t int"
# Shared features: kim and lee four (type, net-b, dev-2, trace), kim and bot7 one (ping), lee and bot7 two (dev-3, dig).
EXAMPLE = [
    ("kim", "human", "net-a", "dev-1", "ping trace"), ("kim", "human", "net-b", "dev-2", "ping"), ("lee", "human", "net-b", "dev-2", "trace dig"),
    ("lee", "human", "net-b", "dev-3", "dig"), ("bot7", "service", "net-c", "dev-3", "ping dig copy"),
]


def frame(spark, data):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(data)], SIM)


def test_worked_example(spark):
    df = frame(spark, EXAMPLE)
    uf = gr.user_features(df)
    assert rows(gr.projected_edges(uf)) == [("bot7", "kim", 1), ("bot7", "lee", 2), ("kim", "lee", 4)]
    got = {r.user: r for r in gr.graph_features(df, ["t"]).collect()}
    assert {u: r.degree for u, r in got.items()} == {"kim": 5.0, "lee": 6.0, "bot7": 3.0}
    c = (4 * 1 * 2) ** (1 / 3) / 4
    assert [got[u].clustering for u in ("kim", "lee", "bot7")] == pytest.approx([c] * 3)
    h = -(4 / 5 * math.log2(4 / 5) + 1 / 5 * math.log2(1 / 5))
    assert got["kim"].neighbor_type_entropy == pytest.approx(h) == got["kim"].neighbor_type_entropy_norm
    assert got["bot7"].neighbor_type_entropy == 0.0 and got["bot7"].user_type == "service"


def brute_force(sets):
    """Edges and weighted clustering by listing all pairs and triples."""
    w = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n:
            w[a, b] = w[b, a] = n
    top = max(w.values(), default=1)
    clustering = {}
    for u in sets:
        near = [v for v in sets if (u, v) in w]
        k = len(near)
        s = sum((w[u, v] * w[u, x] * w[v, x]) ** (1 / 3) / top for v, x in itertools.combinations(near, 2) if (v, x) in w)
        clustering[u] = s / (k * (k - 1) / 2) if k > 1 else 0.0
    return {(a, b, n) for (a, b), n in w.items() if a < b}, clustering


def random_sets(seed, users, copies):
    rng = random.Random(seed)
    sets = {f"u{i:02d}": {f"f{rng.randrange(14)}" for _ in range(rng.randrange(1, 5))} for i in range(users)}
    for i in range(copies):
        sets[f"copy{i:02d}"] = set(sets["u00"])
    sets["alone"] = {"only mine"}
    return sets


@pytest.mark.parametrize("block_size", [1000, 9, 4])
@pytest.mark.parametrize("copies", [0, 14])
def test_matches_brute_force(spark, block_size, copies):
    sets = random_sets(block_size + copies, 25, copies)
    uf = spark.createDataFrame([(u, f) for u, fs in sets.items() for f in fs], "user string, feature string")
    edges, clustering = brute_force(sets)
    assert set(rows(gr.projected_edges(uf, block_size=block_size))) == edges
    got = dict(rows(gr.weighted_clustering(uf, block_size=block_size)))
    assert got == pytest.approx(clustering)
    degree = {u: sum(n for a, b, n in edges if u in (a, b)) for u in sets}
    assert dict(rows(gr.weighted_degree(uf))) == degree


def test_many_features_in_strips(spark, monkeypatch):
    monkeypatch.setattr(gr, "FEATURE_STRIP", 5)
    sets = random_sets(7, 20, 2)
    uf = spark.createDataFrame([(u, f) for u, fs in sets.items() for f in fs], "user string, feature string")
    assert set(rows(gr.projected_edges(uf))) == brute_force(sets)[0]


def test_days_are_separate_graphs(spark):
    data = [(d, u, f) for d in (1, 2) for u, f in (("a", "x"), ("b", "x"), ("c", "x" if d == 1 else "y"))]
    uf = spark.createDataFrame(data, "d int, user string, feature string")
    assert rows(gr.projected_edges(uf, ["d"])) == [(1, "a", "b", 1), (1, "a", "c", 1), (1, "b", "c", 1), (2, "a", "b", 1)]
    assert rows(gr.weighted_clustering(uf, ["d"])) == [(1, "a", 1.0), (1, "b", 1.0), (1, "c", 1.0), (2, "a", 0.0), (2, "b", 0.0), (2, "c", 0.0)]


def test_types_without_pairs_equal_pairs(spark):
    sets = random_sets(5, 25, 5)
    uf = spark.createDataFrame([(u, f) for u, fs in sets.items() for f in fs], "user string, feature string")
    kinds = {u: ("x", "y", "z")[i % 3] for i, u in enumerate(sets)}
    types = spark.createDataFrame(list(kinds.items()), "user string, user_type string")
    expected = {}
    for a, b, n in brute_force(sets)[0]:
        for u, v in ((a, b), (b, a)):
            expected[u, kinds[v]] = expected.get((u, kinds[v]), 0) + n
    assert {(u, t): w for u, t, w in rows(gr.neighbor_types(uf, types))} == expected


def test_nulls_and_last_type(spark):
    df = frame(spark, [("a", None, None, "d", " "), ("a", "human", None, "d", None), ("b", "svc", "n", None, "x x y")])
    assert rows(gr.user_features(df)) == [
        ("a", "device_ip:d"), ("a", "user_type:human"), ("b", "cmd:x"), ("b", "cmd:y"), ("b", "remote_network:n"), ("b", "user_type:svc")]
    kept = [f for u, f in rows(gr.user_features(df, keep_nulls=True)) if u == "a"]
    assert kept == ["device_ip:d", "remote_network:nan", "user_type:human", "user_type:nan"]
    assert rows(gr.last_type(df, ["t"])) == [("a", "human"), ("b", "svc")]
    assert rows(gr.last_type(df.where("t = 0"), ["t"])) == [("a", "unknown")]
    with pytest.raises(ValueError):
        gr.user_features(df.drop("user_type"))


def test_users_without_features_are_no_nodes(spark):
    df = frame(spark, [("a", None, None, None, None), ("b", "human", None, None, None), (None, "human", None, None, " ")])
    got = gr.graph_features(df, ["t"])
    assert rows(got, "user", "degree", "user_type") == [("b", 1.0, "human"), ("nan", 1.0, "human")]


def test_subgraph_threshold_and_sample(spark):
    df = frame(spark, EXAMPLE)
    edges = gr.projected_edges(gr.user_features(df))
    nodes = spark.createDataFrame([("kim",), ("lee",)], "user string")
    assert rows(gr.induced_subgraph(edges, nodes)) == [("kim", "lee", 4)]
    assert gr.threshold_edges(edges, 1).count() == 3 and gr.threshold_edges(edges, 2).count() == 2
    nodes, links = gr.graph_sample(df, ["t"], n=2, min_weight=2, n_labels=1)
    assert rows(nodes, "user", "degree", "size", "labelled") == [("kim", 5, 80.0, False), ("lee", 6, 80.0, True)]
    assert rows(links, "src", "dst", "weight") == [("kim", "lee", 4)]


def test_daily_shape(spark):
    df = frame(spark, EXAMPLE).withColumn("event_date", F.lit("2024-01-01").cast("date"))
    got = gr.daily_graph_features(df, ["t"])
    assert got.columns == ["user", "event_date", "entropy", "degree", "clustering_coefficient"] and got.count() == 3


def test_clustering_copies_a_set_few_times(spark):
    """A day of 20,000 sets is dealt into two blocks, so a row is copied three times, not once per pair of twenty blocks."""
    classes = spark.range(20_000).select(
        F.lit("d").alias("day"), F.array(F.col("id").cast("string")).alias("features"), F.lit(1.0).alias("members"))
    copies = block_triples(gr._cluster_blocks(classes, ["day"], None)).count()
    assert copies <= 4 * 20_000
    alone = gr._cluster_blocks(classes.limit(3000), [], None)
    assert alone.agg(F.max("n_blocks")).first()[0] == 3


def test_common_features_of_tiles(monkeypatch):
    monkeypatch.setattr(gr, "TILE_SIZE", 4)
    monkeypatch.setattr(gr, "FEATURE_STRIP", 3)
    rng = random.Random(4)
    sets = [sorted(rng.sample("abcdefghijk", rng.randint(1, 8))) for _ in range(19)]
    rows_of = {0: np.arange(0, 19, 2), 1: np.arange(1, 19, 2)}
    tiles = gr._tiles(pa.chunked_array([pa.array(sets)]), rows_of)
    for one in tiles[0] + tiles[1]:
        for other in tiles[0] + tiles[1]:
            found = gr._common(one, other)
            for x, i in enumerate(one.rows):
                for y, j in enumerate(other.rows):
                    assert found[x, y] == (0 if i == j else len(set(sets[i]) & set(sets[j])))


def test_edges_among_users_are_those_of_the_whole_graph(spark):
    """Others are not paired: the plan of few users has no rows of the rest, and edges keep their weights."""
    uf = spark.createDataFrame([(f"u{k}", f"f{j}") for k in range(12) for j in range(6) if (k * 7 + j * 5) % 4], "user string, feature string")
    chosen = uf.where(F.col("user").isin("u1", "u4", "u9", "u11")).select("user").distinct()
    assert rows(gr.projected_edges(uf, among=chosen)) == rows(gr.induced_subgraph(gr.projected_edges(uf), chosen))


def test_edges_copy_a_user_few_times(spark):
    """20,000 users are dealt into eight blocks, so a row is copied eight times, not once per each of twenty blocks."""
    users = spark.range(20_000).select(F.col("id").cast("string").alias("user"), F.array(F.lit("x")).alias("features"))
    copies = block_pairs(gr._few_blocks(users, [], ["user"], gr.EDGE_BLOCK, None)).count()
    assert copies == 8 * 20_000


def test_edges_of_many_tiles_by_key(spark, monkeypatch):
    monkeypatch.setattr(gr, "TILE_SIZE", 4)
    sets = random_sets(11, 23, 3)
    data = [(d, u, f) for d in (2, 1) for u, fs in sets.items() for f in fs]
    uf = spark.createDataFrame(data, "d int, user string, feature string")
    edges = brute_force(sets)[0]
    for block_size in (None, 6):
        got = gr.projected_edges(uf, ["d"], block_size=block_size)
        assert got.dtypes == [("d", "int"), ("src", "string"), ("dst", "string"), ("weight", "bigint")]
        found = [tuple(r) for r in got.collect()]
        assert len(found) == 2 * len(edges) and set(found) == {(d, *e) for d in (2, 1) for e in edges}
