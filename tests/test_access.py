import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import plan, rows
from tidewatch.config import AccessConfig
from tidewatch.operators import access as ac
from tidewatch.plans import access as plans
from tidewatch.sources import load_baseline, save_baseline
from workload import queries as q
from workload import views

T, D = dt.datetime, dt.date
RAW = "user string, _time string, uid string, remote_address string, device_ip_address string, cmd string, user_type string"


def raw(spark, data):
    return spark.createDataFrame(data, RAW)


def events(spark, data):
    return ac.preprocess_access(raw(spark, data))


def test_preprocess(spark):
    got = events(spark, [
        ("a", "2026-03-01 10:00:00", "1", None, "d", None, "human"), (None, "2026-03-01 10:00:00", "2", "r", "d", "x", "human"),
        ("a", "never", "3", "r", "d", "x", "human"), ("b", "2026-03-02", None, "r", "d", " reload now", None)])
    assert rows(got, "user", "uid", "remote_address", "cmd_group", "user_type", "event_date") == [
        ("a", "1", "nan", "UNKNOWN_CMD", "human", D(2026, 3, 1)), ("b", "nan", "r", "RELOAD", "nan", D(2026, 3, 2))]
    with pytest.raises(ValueError, match="uid"):
        ac.preprocess_access(raw(spark, []).drop("uid"))


def test_other_column_names(spark):
    renamed = raw(spark, [("a", "2026-03-01 10:00:00", "1", "r", "d", "x", "human")]).withColumnRenamed("cmd", "command")
    assert ac.preprocess_access(renamed, AccessConfig({"cmd": "command"})).first().cmd_group == "X"


def random_events(seed, n=400):
    """Ties in time, repeated uids, exact copies, and one user with a third of the rows."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(6)}"
        out.append((user, f"2026-03-{1 + rng.randrange(9):02d} 10:00:0{rng.randrange(3)}", str(rng.randrange(20)),
                    f"r{rng.randrange(4)}", f"d{rng.randrange(5)}", rng.choice(["reload", "copy x", "ping", "show run"]),
                    "functional" if user in ("hot", "u1") else "human"))
    return out + rng.choices(out, k=n // 4)


def sequential_novelty(data):
    """The same flags one event at a time, ties by device, remote and command."""
    groups = {"reload": "RELOAD", "copy x": "COPY", "ping": "PING", "show run": "SHOW_CONFIG"}
    seen, out = set(), []
    for user, time, uid, remote, device, cmd, kind in sorted(data, key=lambda e: (e[0], e[1], e[2], e[4], e[3], e[5])):
        group = groups[cmd]
        keys = [("r", remote), ("d", device), ("c", group), ("rc", remote, group), ("dc", device, group)]
        out.append((user, T.fromisoformat(time), uid, remote, device, cmd, *[int((user, *k) not in seen) for k in keys]))
        seen |= {(user, *k) for k in keys}
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_novelty_history_equals_sequential(spark, seed):
    data = random_events(seed)
    got = ac.expand_copies(ac.novelty_history(events(spark, data)))
    assert rows(got, "user", "_time", "uid", "remote_address", "device_ip_address", "cmd", *ac.FLAGS) == sequential_novelty(data)


def test_very_many_copies(spark, monkeypatch):
    one = ac.novelty_history(events(spark, [("a", "2026-03-01 10:00:00", "1", "r", "d", "x", "human")] * 25))
    assert rows(one, "weight", "new_remote") == [(1, 1), (24, 0)]
    monkeypatch.setattr(ac, "COPY_CHUNK", 10)
    assert rows(ac.expand_copies(one).groupBy("new_remote").count()) == [(0, 24), (1, 1)]


def test_uid_orders_as_text(spark):
    got = ac.novelty_history(events(spark, [
        ("a", "2026-03-01 10:00:00", "9", "r1", "d", "x", "human"), ("a", "2026-03-01 10:00:00", "10", "r1", "d", "x", "human")]))
    assert rows(got, "uid", "new_remote") == [("10", 1), ("9", 0)]


def test_groups_give_the_same_user_days(spark):
    clean = events(spark, random_events(3))
    by_event = ac.user_day_features(ac.event_risk(ac.novelty_history(clean)))
    by_group = ac.user_day_features(ac.event_risk(ac.novelty_history(clean, by_event=False)))
    assert rows(by_event) == rows(by_group)
    base = ac.known_keys(clean.where("event_date < '2026-03-04'")).withColumn("as_of", F.lit(None).cast("date"))
    by_event = ac.user_day_features(ac.event_risk(ac.novelty_baseline(clean, base)))
    by_group = ac.user_day_features(ac.event_risk(ac.novelty_baseline(clean, base, by_event=False)))
    assert rows(by_event) == rows(by_group)


def test_novelty_reads_events_once_per_use(spark, sf):
    """The aggregate behind groups and first sightings is shuffled once and reused."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(ac.novelty_history(ac.preprocess_access(views.access(spark, sf)), by_event=False))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert text.count("FileScan") == 1 and "ReusedExchange" in text and "Window" not in text


def test_baseline_flags_every_event(spark):
    known = events(spark, [("a", "2026-03-01 10:00:00", "1", "r1", "d1", "reload", "human")])
    base = ac.update_baseline(spark.createDataFrame([], "user string, kind string, v1 string, v2 string, as_of date"), known, "2026-03-01")
    assert base.count() == 5
    batch = events(spark, [
        ("a", "2026-03-02 10:00:00", "1", "r2", "d1", "reload", "human"), ("a", "2026-03-02 11:00:00", "2", "r2", "d1", "reload", "human"),
        ("new", "2026-03-02 11:00:00", "3", "r1", "d1", "reload", "human")])
    assert rows(ac.novelty_baseline(batch, base), "uid", *ac.FLAGS) == [("1", 1, 0, 0, 1, 0), ("2", 1, 0, 0, 1, 0), ("3", 1, 1, 1, 1, 1)]
    grown = ac.update_baseline(base, batch, "2026-03-02")
    assert grown.count() == 5 + 2 + 5
    assert ac.update_baseline(grown, batch, "2026-03-03").count() == 12
    assert ac.novelty_baseline(batch, grown).where(" or ".join(f"{f} = 1" for f in ac.FLAGS)).count() == 0


RULES = "user string, rule_id string, rule_ord int, any_remote boolean, any_device boolean, any_command boolean, allowed_remote_ips array<string>, allowed_device_ips array<string>, allowed_commands array<string>"


def functional(spark, user="svc", remote="r1", device="d1", cmd="reload", kind="functional"):
    return events(spark, [(user, "2026-03-01 10:00:00", "1", remote, device, cmd, kind)])


@pytest.mark.parametrize("rules, expected", [
    ([("r1", 1, False, False, False, ["r1"], ["d1"], ["RELOAD"])], ("ALLOW", 0.0, 0.0, "r1", "r1")),
    ([("r1", 1, False, False, False, ["x"], ["d1"], ["RELOAD"]), ("r2", 2, True, True, True, None, None, None)], ("ALLOW", 0.0, 0.0, "r2", "r2")),
    ([("r1", 1, False, False, False, ["x"], ["d1"], ["RELOAD"]), ("r2", 2, False, False, False, ["r1"], ["x"], ["RELOAD"])], ("VIOLATION", 60.0, 0.0, "r1", None)),
    ([("r1", 1, True, True, False, None, None, None)], ("UNKNOWN", 0.0, 15.0, "r1", None)),
    ([("r1", 1, False, False, False, [], [], [])], ("VIOLATION", 200.0, 0.0, "r1", None)),
    ([("r1", 1, False, False, False, ["r1"], ["d1"], ["x"]), ("r2", 2, False, False, True, ["r1"], None, None)], ("UNKNOWN", 80.0, 0.0, "r1", None)),
    ([], ("UNKNOWN", 0.0, 35.0, None, None)),
])
def test_policy(spark, rules, expected):
    table = spark.createDataFrame([("svc", *r) for r in rules], RULES)
    got = ac.policy_features(functional(spark), table)
    assert rows(got, "policy_status", "policy_risk", "control_gap_risk", "best_rule_id", "matched_rule_id") == [expected]


def test_policy_reads_comma_text_and_rule_id_order(spark):
    table = spark.createDataFrame(
        [("svc", "b", False, True, True, "r1, r9", None, None), ("svc", "a", False, True, True, " ", None, None)],
        "user string, rule_id string, any_remote boolean, any_device boolean, any_command boolean, allowed_remote_ips string, allowed_device_ips string, allowed_commands string")
    assert rows(ac.policy_features(functional(spark), table), "policy_status", "best_rule_id") == [("ALLOW", "b")]
    assert rows(ac.policy_features(functional(spark, remote="z"), table), "policy_status", "best_rule_id") == [("UNKNOWN", "a")]


def test_policy_skips_people_and_missing_rules(spark):
    table = spark.createDataFrame([("svc", "r1", 1, False, False, False, [], [], [])], RULES)
    people = ac.policy_features(functional(spark, kind="human"), table)
    assert rows(people, "policy_status", "policy_risk", "remote_unknown", "best_rule_id") == [("NA", 0.0, 0, None)]
    assert rows(ac.policy_features(functional(spark), None), "policy_status", "control_gap_risk") == [("UNKNOWN", 35.0)]
    assert "Python" not in plan(people)


def test_risk_and_user_day(spark):
    clean = events(spark, [
        ("svc", "2026-03-01 10:00:00", "1", "r1", "d1", "reload", "functional"), ("svc", "2026-03-01 11:00:00", "2", "r1", "d1", "reload", "functional")])
    table = spark.createDataFrame([("svc", "r1", 1, False, False, False, [], [], [])], RULES)
    day = ac.user_day_features(ac.event_risk(ac.policy_features(ac.novelty_history(clean), table))).first()
    assert (day.total_events, day.new_remote_rate, day.max_risk_norm, day.avg_risk_norm) == (2, 0.5, 1.0, (325 + 200) / 2 / 325)
    assert (day.policy_violation_rate, day.unknown_policy_ratio, day.avg_policy_risk) == (3.0, 0.0, 200.0)
    basic = ac.user_day_features(ac.event_risk_basic(ac.novelty_history(clean)), counts=True).first()
    assert (basic.max_risk_norm, basic.avg_risk_norm, basic.new_device_count) == (1.0, 0.5, 1)
    assert "policy_violation_rate" not in basic


def test_graph_merge_defaults_and_duplicates(spark):
    days = spark.createDataFrame([("a", D(2026, 3, 1), 4), ("b", D(2026, 3, 1), 2)], "user string, event_date date, total_events long")
    schema = "user string, event_date date, entropy double, degree double, clustering_coefficient double"
    one = spark.createDataFrame([("a", D(2026, 3, 1), 0.9, 8.0, 0.5)], schema)
    got = ac.merge_graph_features(days, one)
    assert rows(got, "user", "entropy_norm", "degree_norm", "clustering_coeff") == [("a", 0.9, 2.0, 0.5), ("b", 0.0, 0.0, 0.0)]
    with pytest.raises(PySparkException, match="repeat user a"):
        ac.merge_graph_features(days, one.union(one)).collect()
    with pytest.raises(ValueError):
        ac.merge_graph_features(days, one.drop("degree"))


def user_days(spark, data):
    return spark.createDataFrame(data, "user string, event_date date, user_type string, total_events long, new_remote_rate double, new_device_rate double, new_remote_cmd_pair_rate double, policy_violation_rate double")


def test_warmup_and_training_sets(spark):
    data = [("h", D(2026, 3, d), "human", 1, 0.2, 1.0, 0.2, 1.0) for d in (1, 5, 6)]
    data += [("h2", D(2026, 3, d), "human", 1, 0.25, 0.0, 0.0, 0.0) for d in (1, 9)]
    data += [("f", D(2026, 3, d), "functional", 1, 0.0, 0.0, 0.0, v) for d, v in ((1, 0.0), (7, 0.0), (8, 0.0), (9, 0.5))]
    days = ac.warmup(user_days(spark, data))
    assert rows(days.where("user = 'f'"), "days_since_first_seen", "is_warmup") == [(0, True), (6, True), (7, False), (8, False)]
    assert rows(ac.human_training_set(days), "user", "event_date") == [("h", D(2026, 3, 6))]
    assert rows(ac.functional_training_set(days), "event_date") == [(D(2026, 3, 8),)]
    assert ac.functional_training_set(days.drop("policy_violation_rate")).count() == 2


def test_reasons(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0.9, 0.0625), (0.0, 0.5, 0.8, 0.0)], "new_remote_rate double, max_risk_norm double, entropy_norm double, policy_violation_rate double")
    assert [r.reasons for r in ac.explain(df).collect()] == [
        ["new_remote_rate=0.500", "policy_violation_rate=0.062", "entropy_norm=0.900"], ["isolated_by_feature_combination"]]
    assert ac.explain(df, ac.REASONS_BASIC).first().reasons == ["new_remote_rate=0.500", "entropy_norm=0.900", "policy_violation_rate=0.062"]


SMALL = AccessConfig(n_trees=20)


def test_training_and_repeated_inference(spark, sf, tmp_path):
    raw_log, rules, graph = views.access(spark, sf), views.rules(spark, sf), q.daily_graph(spark, sf)
    models, baseline = str(tmp_path / "models"), str(tmp_path / "baseline")
    tables = plans.train_and_save(spark, raw_log, graph, rules, models, SMALL)
    assert tables["event_features"].count() == raw_log.count()
    assert load_baseline(spark, baseline).count() == 0
    first = raw_log.where("_time < timestamp_ntz'2024-01-21'")
    second = raw_log.where("_time >= timestamp_ntz'2024-01-21'")
    cold = plans.infer_and_update(spark, first, graph, rules, models, baseline, "2024-01-20", SMALL)["scored_user_days"]
    assert cold.where("new_remote_rate < 1").count() == 0
    keys = load_baseline(spark, baseline).count()
    assert keys == ac.known_keys(ac.preprocess_access(first)).count()
    once = plans.infer_and_update(spark, second, graph, rules, models, baseline, "2024-01-30", SMALL)["scored_user_days"]
    grown = rows(load_baseline(spark, baseline))
    assert len(grown) > keys
    twice = plans.infer_and_update(spark, second, graph, rules, models, baseline, "2024-01-30", SMALL)["scored_user_days"]
    assert rows(once) == rows(twice) and rows(load_baseline(spark, baseline)) == grown
    scores = [r.iforest_score for r in once.collect()]
    assert scores == sorted(scores)
    assert once.where("user_type = 'human' and direct_policy_alert is not null").count() == 0
    assert once.where("user_type = 'functional' and direct_policy_alert is null").count() == 0
    assert once.where("is_anomaly != (iforest_pred = -1) or is_anomaly != (iforest_score < 0)").count() == 0


def test_empty_training_set_is_an_error(spark, sf):
    few = views.access(spark, sf).where("_time < timestamp_ntz'2024-01-03'")
    graph = spark.createDataFrame([], "user string, event_date date, entropy double, degree double, clustering_coefficient double")
    with pytest.raises(ValueError, match="empty"):
        plans.train(few, graph, None, SMALL)
    with pytest.raises(ValueError, match="no user-day"):
        plans.one_shot(few.limit(0), graph, SMALL)


def test_save_baseline_replaces_its_own_date_only(spark, tmp_path):
    schema = "user string, kind string, v1 string, v2 string, as_of date"
    path = str(tmp_path / "b")
    for data in ([("a", "remote", "x", None, D(2026, 1, 1))], [("a", "remote", "y", None, D(2026, 1, 2))], [("a", "cmd", "z", None, D(2026, 1, 2))]):
        save_baseline(spark.createDataFrame(data, schema), path)
    assert rows(load_baseline(spark, path), "v1") == [("x",), ("z",)]
