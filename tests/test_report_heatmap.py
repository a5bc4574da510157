import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan, rows
from tidewatch.operators import heatmap as hm
from tidewatch.operators import report as rp
from tidewatch.plans.report import account_drill_in_range, date_filter, user_drill_in_range
from tidewatch.schemas import REPORT_COLUMNS
from tidewatch.sources import load_report

T, D = dt.datetime, dt.date


@pytest.fixture()
def calls(spark):
    return spark.createDataFrame([
        ("alice", "A1", "x", T(2024, 1, 1, 8)), ("alice", "A2", "x", T(2024, 1, 1, 9)), ("alice", "A1", "x", T(2024, 1, 2, 23, 59, 59, 999999)),
        ("bob", "A1", "y", T(2024, 1, 2, 7)), ("bob", "A1", "y", T(2024, 1, 3, 0)),
    ], "user string, account string, id_chat string, dttm timestamp_ntz")


def test_range_ends_at_last_microsecond(calls):
    assert rp.filter_range(calls, "2024-01-01", "2024-01-02").count() == 4
    assert rp.filter_range(calls).count() == 1
    assert rp.filter_range(calls, "2024-01-01", None).count() == 1


def test_range_reaches_the_scan(spark, calls, tmp_path):
    calls.write.parquet(str(tmp_path / "t"))
    df = rp.filter_range(spark.read.parquet(str(tmp_path / "t")), "2024-01-01", "2024-01-02")
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(dttm" in scan and "LessThan(dttm" in scan


def test_users_by_day(calls):
    got = [tuple(r) for r in rp.users_by_day(calls).collect()]
    a, b = (T(2024, 1, 1, 8), T(2024, 1, 2, 23, 59, 59, 999999)), (T(2024, 1, 2, 7), T(2024, 1, 3, 0))
    assert got == [
        (D(2024, 1, 3), "bob", 1, 2, *b), (D(2024, 1, 2), "alice", 1, 2, *a), (D(2024, 1, 2), "bob", 1, 2, *b),
        (D(2024, 1, 1), "alice", 2, 2, *a)]


def test_empty_range_keeps_columns(calls):
    got = rp.users_by_day(rp.filter_range(calls, "2030-01-01", "2030-01-02"))
    assert got.count() == 0
    assert got.columns == ["date", "user", "suspicious_accounts_for_day", "active_days", "first_seen", "last_seen"]


def test_rows_without_user_or_time_are_not_users(spark, calls):
    extra = spark.createDataFrame([(None, "A", "x", T(2024, 1, 1)), ("zed", "A", "x", None)], calls.schema)
    got = rp.users_by_day(rp.filter_range(calls.union(extra), "2024-01-01", "2024-01-03"))
    assert rows(got) == rows(rp.users_by_day(calls))


def test_drills_and_bounds(calls):
    r = rp.attach_unique_accounts(calls)
    assert [x.dttm for x in rp.user_drill(r, "alice").collect()] == ["2024-01-01 08:00:00", "2024-01-01 09:00:00", "2024-01-02 23:59:59"]
    assert [x.user for x in rp.account_drill(r, "A1").collect()] == ["alice", "bob", "alice", "bob"]
    assert rows(r.where("user = 'alice'"), "num_of_unique_suspicious_accounts") == [(1,), (2,), (2,)]
    assert rows(rp.date_bounds(calls)) == [(D(2024, 1, 1), D(2024, 1, 3), D(2024, 1, 3), D(2024, 1, 3))]


def test_drills_in_range_filter_before_they_count(spark, calls, tmp_path):
    """The same rows as counting everything first, and the range reaches every scan."""
    calls.write.parquet(str(tmp_path / "calls"))
    stored = spark.read.parquet(str(tmp_path / "calls"))
    whole = rp.filter_range(rp.attach_unique_accounts(stored), "2024-01-01", "2024-01-02")
    for got, want in (
        (account_drill_in_range(stored, "A1", "2024-01-01", "2024-01-02"), rp.account_drill(whole, "A1")),
        (user_drill_in_range(stored, "alice", "2024-01-01", "2024-01-02"), rp.user_drill(whole, "alice")),
    ):
        assert rows(got, *want.columns) == rows(want)
        pushed = [line for line in plan(got).split("PushedFilters: ")[1:]]
        assert pushed and all("GreaterThanOrEqual(dttm" in p and "LessThan(dttm" in p for p in pushed)


def test_date_filter_shows_times_as_text(calls):
    shown, table = date_filter(calls, "2024-01-01", "2024-01-01")
    assert {r.dttm for r in shown.collect()} == {"2024-01-01 08:00:00", "2024-01-01 09:00:00"}
    assert [r.first_seen for r in table.collect()] == ["2024-01-01 08:00:00"]


def test_load_report_types(spark):
    text = {c: "x" for c in REPORT_COLUMNS} | {"dttm": "2024-01-01 01:00:00", "date": "bad"}
    got = load_report(spark.createDataFrame([tuple(text.values())], list(text)))
    assert dict(got.dtypes)["dttm"] == "timestamp_ntz" and got.first()["date"] is None
    with pytest.raises(ValueError):
        load_report(spark.range(1))


@pytest.fixture()
def log(spark):
    return spark.createDataFrame([
        ("2024-01-01 00:10:00", "h1", "ls", "human"), ("2024-01-01 00:20:00", "h1", "ls", "human"),
        ("2024-01-01 05:00:00", "h2", "cd", "human"), ("2024-01-07 23:00:00", "h2", "ls", "human"),
        ("2024-01-02 01:00:00", "f1", "run", "functional"), ("bad", "h1", "ls", "human"), ("2024-01-02 03:00:00", "o", "x", "other"),
    ], "timestamp string, user string, command string, account_type string")


def cell(df, day, hour):
    return df.where((F.col("day") == day) & (F.col("hour") == hour)).first().n


@pytest.mark.parametrize("mode, expected", [("none", (2.0, 1.0)), ("global", (1.0, 0.5)), ("row", (2 / 3, 1 / 3)), ("col", (1.0, 1.0))])
def test_role_heatmap_modes(log, mode, expected):
    got = hm.role_heatmap(log, "human", mode)
    assert got.count() == 168
    assert (cell(got, 0, 0), cell(got, 0, 5)) == pytest.approx(expected)
    assert cell(got, 3, 3) == 0.0


def test_bad_mode(log):
    with pytest.raises(ValueError):
        hm.role_heatmap(log, "human", "diagonal")
    with pytest.raises(ValueError):
        hm.top_user_heatmaps(log, normalize="diagonal")


def test_roles_are_scaled_alone(log):
    got = hm.compare_roles(log, "global")
    assert got.groupBy("account_type").agg(F.max("n").alias("m")).where("m = 1.0").count() == 2


def test_asked_roles_without_events_are_zero(log):
    got = hm.role_heatmap(log, "nobody")
    assert got.count() == 168 and got.agg(F.sum("n")).first()[0] == 0.0
    assert hm.compare_roles(log, roles=("human", "nobody")).groupBy("account_type").count().count() == 2


def test_top_users_break_ties_by_name(log):
    assert [tuple(r) for r in hm.top_users(log, "human", 1).collect()] == [("h1", 2)]
    assert {r.user for r in hm.top_user_heatmaps(log, "human", 1).collect()} == {"h1"}


def test_user_hour_matrix(spark):
    data = spark.createDataFrame([("b", 1, 2.0), ("a", 168, None), ("a", 168, 3.0)], "user string, index_value int, metric_value double")
    got = hm.user_hour_matrix(data).collect()
    assert [r.user for r in got] == ["a", "b"] and len(got[0]) == 169
    assert (got[0]["168"], got[0]["1"], got[1]["1"]) == (3.0, 0.0, 2.0)


def test_cluster_views(spark, log):
    labels = spark.createDataFrame([("ls", 0), ("cd", 1), ("run", 1)], "command string, cluster int")
    usage = hm.cluster_usage(log, labels)
    assert usage.count() == 2 * 168
    assert cell(usage.where("cluster = 0"), 0, 0) == 1.0 and cell(usage.where("cluster = 0"), 6, 23) == 0.5
    from tidewatch.operators.roles import hour_profile
    mean = hm.cluster_hour_mean(hour_profile(log), labels)
    total = {r.cluster: r.s for r in mean.groupBy("cluster").agg(F.sum("share").alias("s")).collect()}
    assert total == pytest.approx({0: 1.0, 1: 1.0})
