import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan, rows
from tidewatch.ml.kmeans import assigned, first_centres, k_means
from tidewatch.operators import accounts as acc
from tidewatch.operators import roles as ro
from tidewatch.operators import similarity as si


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(4)
    data = []
    for c in range(24):
        share = (0.05, 0.9)[c % 2]
        for _ in range(60):
            hour = rng.randrange(9, 17) if c % 3 else rng.randrange(0, 5)
            role = "human" if rng.random() < share else "functional"
            data.append((f"2024-01-{1 + rng.randrange(14):02d} {hour:02d}:00:00", f"u{rng.randrange(5)}", f"c{c}", role))
    data += [("2024-01-01 00:00:00", "x", "odd", "robot"), ("never", "x", "c1", "human")]
    return spark.createDataFrame(data, "timestamp string, user string, command string, account_type string").cache()


def test_role_counts_and_proportions(log):
    props = {r.command: r for r in ro.role_proportions(log).collect()}
    assert (props["odd"].human_prop, props["odd"].functional_prop) == (0.0, 0.0)
    assert all(r.human_prop + r.functional_prop == pytest.approx(1) for c, r in props.items() if c != "odd")


def test_hour_profile_is_dense_and_sums_to_one(log):
    got = ro.hour_profile(log).groupBy("command").agg(F.count("*").alias("n"), F.sum("share").alias("s")).collect()
    assert {r.n for r in got} == {168}
    assert [r.s for r in got] == pytest.approx([1.0] * len(got))


def test_role_clusters_find_the_best_split(log):
    found = ro.role_clusters(log.where("command != 'odd'"))
    got = found.rows.collect()
    line = sorted(r.human_prop for r in got)

    def cost(parts):
        return sum(2 * sum((x - statistics.fmean(p)) ** 2 for x in p) for p in parts)

    best = min(cost((line[:i], line[i:])) for i in range(1, len(line)))
    split = [[r.human_prop for r in got if r.cluster == c] for c in (0, 1)]
    assert cost(split) == pytest.approx(best)
    # clusters are numbered by their centres
    assert statistics.fmean(split[0]) < statistics.fmean(split[1])
    stats = found.stats.first()
    distance = abs(statistics.fmean(split[0]) - statistics.fmean(split[1])) * 2 ** 0.5
    assert stats.centroid_distance == pytest.approx(distance) and 0.5 < stats.silhouette <= 1
    purity = statistics.fmean(r.purity for r in got if r.cluster == 0)
    assert stats.mean_purity_cluster0 == pytest.approx(purity)


def test_purity_tables(spark):
    data = [(f"c{i:03d}", (i % 7) / 7, 1 - (i % 7) / 7, i % 2, max((i % 7) / 7, 1 - (i % 7) / 7)) for i in range(300)]
    df = spark.createDataFrame(data, "command string, human_prop double, functional_prop double, cluster int, purity double")
    got = ro.purity_tables(df, 4).orderBy("cluster", "rank").collect()
    for cluster in (0, 1):
        best = sorted((r for r in data if r[3] == cluster), key=lambda r: (-r[4], r[0]))[:4]
        assert [r.command for r in got if r.cluster == cluster] == [r[0] for r in best]


def test_hour_clusters(log):
    found = ro.hour_clusters(log, k=2)
    got = found.rows.collect()
    assert set(found.rows.columns) == {"command", "cluster", "pc1", "pc2"} and {r.cluster for r in got} == {0, 1}
    assert -1 <= found.stats.first()[0] <= 1
    again = ro.hour_clusters(log.repartition(5), k=2).rows
    assert rows(again, "command", "cluster") == rows(found.rows, "command", "cluster")


def test_clusters_do_not_depend_on_partitions(spark, log):
    """The same clusters for every number of shuffle partitions."""
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            roles, hours = ro.role_clusters(log), ro.hour_clusters(log, k=3, pca=False)
            found.append((rows(roles.rows, "command", "cluster"), rows(hours.rows, "command", "cluster")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_points_at_one_place_are_one_cluster(spark):
    df = spark.createDataFrame([("a", 0.5, 0.5, 0.0), ("b", 0.5, 0.5, 0.0)], "command string, x double, y double, lean double")
    assert {r.cluster for r in ro.best_split(df, "lean", ["x", "y"]).collect()} == {0}
    points = spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "command string, point array<double>")
    assert {r.cluster for r in k_means(points, 3, "command").collect()} == {0}


def test_bounds_leave_lloyds_rounds_as_they_are(spark):
    """Against rounds that compute every distance."""
    rng = random.Random(6)
    data = [(f"k{i:03d}", [rng.gauss(i % 5, 1.2), rng.gauss(i % 3, 1.2), rng.random()]) for i in range(400)] + [("twin", [0.0, 0.0, 0.0])] * 2
    points = spark.createDataFrame(data, "command string, point array<double>").repartition(5)
    for k in (1, 2, 5):
        centres = first_centres(points, k, "command", "point")
        while True:
            label = {r.command: r.cluster for r in assigned(points, "point", centres).collect()}
            after = []
            for c in range(len(centres)):
                mine = [p for key, p in data if label[key] == c]
                after.append([round(sum(x) / len(mine), 9) for x in zip(*mine)] if mine else centres[c])
            if after == centres:
                break
            centres = after
        rank = {c: i for i, c in enumerate(sorted(range(len(centres)), key=lambda c: centres[c]))}
        got = {r.command: r.cluster for r in k_means(points, k, "command").collect()}
        assert got == {key: rank[c] for key, c in label.items()}


def test_compare_without_pairs(log):
    table = {r.metric: r.real for r in ro.compare(log, log, k=2, n=3, exact=False)["summary"].collect()}
    assert 0 < table["role_silhouette"] <= 1 and -1 <= table["hour_of_week_silhouette"] <= 1


def test_compare(log):
    out = ro.compare(log, log, k=2, n=3)
    table = {r.metric: r for r in out["summary"].collect()}
    assert set(table) == {"role_silhouette", "role_centroid_distance", "role_mean_purity_cluster0", "role_mean_purity_cluster1", "hour_of_week_silhouette"}
    assert all(r.real == pytest.approx(r.synthetic) for r in table.values())
    assert {"real_props", "synthetic_hours", "real_purity"} <= set(out)


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line, last = [i], line
        for j, y in enumerate(b, 1):
            line.append(min(last[j] + 1, line[-1] + 1, last[j - 1] + (x != y)))
    return line[-1]


def expected_scores(commands, history):
    out = {}
    for user in {u for u, _ in commands}:
        known = history.get(user, {})
        mine = [c for u, c in commands if u == user]
        sims = []
        for c in mine:
            if c in known:
                sims.append(1.0)
            else:
                total = sum(known.values())
                part = sum(f * (1 - distance(c, h) / max(len(c), len(h)) if max(len(c), len(h)) else f) for h, f in known.items())
                sims.append(part / total if total else 0.0)
        mean, spread = statistics.fmean(sims), statistics.pstdev(sims)
        for c, s in zip(mine, sims):
            z = 0.0 if len(sims) == 1 else ((s - mean) / spread if spread > 1e-12 else None)
            out[user, c] = (s, z, z is not None and round(z, 9) < -2)
    return out


@pytest.mark.parametrize("block_size", [256, 3])
def test_similarity_anomalies(spark, block_size):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 7)))
    history, commands = {}, []
    for u in ("hot", "b", "c"):
        history[u] = {word(): rng.randrange(1, 5) for _ in range(25 if u == "hot" else 6)}
        commands += [(u, rng.choice([word(), rng.choice(list(history[u]))])) for _ in range(40 if u == "hot" else 9)]
    commands += [("new", "ls"), ("new", "cd"), ("single", "x"), ("flat", "k"), ("flat", "k")]
    history["flat"] = {"k": 2}
    history["single"] = {"xy": 1}
    commands += [("odd", "same")] * 12 + [("odd", "zzzzzzzzzzzz")]
    history["odd"] = {"same": 5}
    cmds = spark.createDataFrame(commands, "user string, cleaned_command string")
    hist = spark.createDataFrame([(u, c, f) for u, h in history.items() for c, f in h.items()], "user string, command string, freq long")
    got = si.similarity_anomalies(cmds, hist, block_size=block_size).collect()
    assert len(got) == len(commands)
    want = expected_scores(commands, history)
    for r in got:
        s, z, flag = want[r.user, r.cleaned_command]
        assert r.weighted_avg_similarity == pytest.approx(s) and r.anomaly == flag
        assert r.z_score is None if z is None else r.z_score == pytest.approx(z)
    assert any(r.anomaly for r in got if r.user == "odd")


def test_five_rows_with_one_odd_are_not_flagged(spark):
    """The z-score is exactly -2, which is not below -2."""
    cmds = spark.createDataFrame([("u", "same")] * 4 + [("u", "qqq")], "user string, cleaned_command string")
    hist = spark.createDataFrame([("u", "same", 3)], "user string, command string, freq long")
    got = si.similarity_anomalies(cmds, hist)
    assert min(r.z_score for r in got.collect()) == pytest.approx(-2) and got.where("anomaly").count() == 0


def test_curation(spark):
    users = spark.createDataFrame([("ABCD1",), ("svc-app",), (None,), ("jdoe",), ("  MiXed ",), ("Vjohn",)], "user string")
    ids = spark.createDataFrame([("abcd1",), ("ABCD1",), (None,), ("SVC-APP",)], "directory_id string")
    got = acc.curate_accounts(users, ids)
    assert rows(got, "user", "is_functional", "user_type") == sorted([
        ("ABCD1", False, "human_user"), ("svc-app", False, "human_user"), (None, False, "human_user"),
        ("jdoe", False, "human_user"), ("  MiXed ", True, "functional_user"), ("Vjohn", False, "human_user")], key=repr)
    assert "Python" not in plan(got)
    assert rows(got.select(acc.to_pipeline_type("user_type").alias("t")).distinct()) == [("functional",), ("human",)]
