import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan, rows
from tidewatch.operators import calls as ca
from tidewatch.operators import heatmap as hm
from tidewatch.plans import calls as plans
from tidewatch.plans.calls import backfill, metrics_of_days, run_daily
from tidewatch.schemas import UNIFIED, UNIFIED_COLUMNS
from tidewatch.sources import file_order, load_unified, read_calls_csv, read_calls_folder

D = dt.date


def write_csv(path, lines, header="user,account,id_chat,dttm"):
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


WEEKS = {
    "calls_01.csv": ["alice,A,Manual call,2024-01-01 09:10:00", "alice,A,other,2024-01-01 09:20:00", "bob,B,,2024-01-01 10:00:00"],
    "calls_02.csv": ["alice,A,manually,2024-01-08 09:10:00", "carol,C,manual,2024-01-08 23:59:59"],
    "calls_03.csv": ["alice,A,manual,2024-01-15 09:00:00", "bob,B,x,2024-01-15 11:00:00", "carol,C,x,2024-01-14 08:00:00"],
}


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    for name, lines in WEEKS.items():
        write_csv(d / name, lines)
    return d


def test_read_csv_cleans_rows(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [
        " alice ,A, Manual call ,2024-01-01 09:10:00", "bob,B,,nonsense", ",C,x,2024-01-01 09:10:00", "eve,E,,2024-01-01 01:00:00"])
    got = rows(read_calls_csv(spark, path), "user", "id_chat", "dttm")
    assert got == [("alice", "Manual call", dt.datetime(2024, 1, 1, 9, 10)), ("eve", None, dt.datetime(2024, 1, 1, 1))]


def test_read_csv_takes_columns_by_name(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", ["2024-01-01 09:10:00,alice,n,A"], "dttm,user,id_chat,account")
    assert rows(read_calls_csv(spark, path), "user", "account") == [("alice", "A")]


def test_read_csv_quotes_and_missing_marks(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [
        'alice,NA,"said ""manual"", then left",2024-01-01 09:10:00', "null,A,x,2024-01-01 09:10:00"])
    assert rows(read_calls_csv(spark, path), "user", "account", "id_chat") == [("alice", None, 'said "manual", then left')]


def test_headers_must_agree(spark, tmp_path):
    write_csv(tmp_path / "a.csv", ["alice,A,x,2024-01-01 09:10:00"])
    write_csv(tmp_path / "b.csv", ["A,alice,x,2024-01-01 09:10:00"], "account,user,id_chat,dttm")
    with pytest.raises(Exception, match="header"):
        read_calls_folder(spark, str(tmp_path)).collect()


def test_empty_file_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        read_calls_csv(spark, write_csv(tmp_path / "a.csv", []))


def test_file_order(spark, folder):
    order = [r.source_file.rsplit("/", 1)[1] for r in file_order(read_calls_folder(spark, str(folder))).collect()]
    assert order == ["calls_01.csv", "calls_02.csv", "calls_03.csv"]


def test_daily_rows_grid(spark, folder):
    got = ca.daily_rows(read_calls_csv(spark, str(folder / "calls_03.csv")))
    assert got.count() == 3 * 24 * 3
    values = {(r.user, r.metric_name, r.index_value): r.metric_value for r in got.collect()}
    assert values["alice", "total calls volume", 10] == 1.0
    assert values["alice", "total manual call volume", 10] == 1.0
    assert values["bob", "user active status", 12] == 1.0
    # carol only called on the day before, and still gets her zero rows
    assert {v for (u, _, _), v in values.items() if u == "carol"} == {0.0}
    assert {r.date for r in got.collect()} == {D(2024, 1, 15)}
    assert {r.index_value for r in got.collect()} == set(range(1, 25))


def test_manual_needs_a_whole_word(spark, folder):
    got = ca.daily_rows(read_calls_csv(spark, str(folder / "calls_02.csv")))
    manual = got.where((F.col("metric_name") == "total manual call volume") & (F.col("metric_value") > 0))
    assert rows(manual, "user", "index_value") == [("carol", 24)]


def unified(spark, data):
    return spark.createDataFrame(data, UNIFIED)


def test_baseline_ignores_current_week_and_sums_repeats(spark):
    t = "total calls volume"
    table = unified(spark, [
        ("a", t, 2.0, 10, D(2024, 1, 1), D(2024, 1, 1), None), ("a", t, 3.0, 10, D(2024, 1, 1), D(2024, 1, 1), None),
        ("a", t, 1.0, 10, D(2024, 1, 8), D(2024, 1, 8), None), ("a", t, 99.0, 10, D(2024, 1, 15), D(2024, 1, 15), None),
        ("a", "average total calls", 7.0, 10, None, None, 3), ("a", t, 5.0, 10, None, None, None),
    ])
    got = ca.baseline(table, "2024-01-15")
    assert rows(got, "user", "metric_name", "metric_value", "n_weeks", "date") == [("a", "average total calls", 3.0, 2, None)]


@pytest.mark.parametrize("policy, expected", [
    ("suppress", {"alice": -0.5}), ("zero", {"alice": -0.5, "bob": None}), ("nan", {"alice": -0.5, "bob": None})])
def test_deviations_with_history(spark, policy, expected):
    t = "total calls volume"
    today = unified(spark, [("alice", t, 1.0, 10, D(2024, 1, 15), D(2024, 1, 15), None), ("bob", t, 4.0, 10, D(2024, 1, 15), D(2024, 1, 15), None)])
    base = unified(spark, [("alice", "average total calls", 1.5, 10, None, None, 2)])
    got = ca.deviations(today, base, policy)
    assert {r.user: r.metric_value for r in got.collect()} == expected
    assert {r.metric_name for r in got.collect()} == {"total calls deviation"}


@pytest.mark.parametrize("policy, expected", [("suppress", []), ("zero", [0.0, 0.0]), ("nan", [None, None])])
def test_deviations_without_history_cover_all_metrics(spark, policy, expected):
    today = unified(spark, [("a", m, 1.0, 1, D(2024, 1, 1), D(2024, 1, 1), None) for m in ("total calls volume", "user active status")])
    got = ca.deviations(today, unified(spark, []), policy, include_active=False)
    assert [r.metric_value for r in got.collect()] == expected


def test_include_active_only_matters_with_history(spark):
    status = "user active status"
    today = unified(spark, [("a", status, 1.0, 1, D(2024, 1, 8), D(2024, 1, 8), None)])
    base = unified(spark, [("a", "average user status", 0.5, 1, None, None, 1)])
    assert ca.deviations(today, base).count() == 1
    assert ca.deviations(today, base, include_active=False).count() == 0


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        ca.deviations(unified(spark, []), unified(spark, []), "other")


@pytest.mark.parametrize("policy", ["suppress", "zero", "nan"])
@pytest.mark.parametrize("anchor", ["monday", "tuesday"])
def test_day_by_day_equals_backfill_and_reruns_change_nothing(spark, folder, tmp_path, policy, anchor):
    one = str(tmp_path / "one")
    for name in sorted(WEEKS):
        last = run_daily(spark, str(folder / name), one, policy, week_anchor=anchor)
    expected = rows(last)
    again = run_daily(spark, str(folder / "calls_03.csv"), one, policy, week_anchor=anchor)
    assert rows(again) == expected
    many = str(tmp_path / "many")
    assert rows(backfill(spark, str(folder), many, cold_start=policy, week_anchor=anchor)) == expected
    assert rows(backfill(spark, str(folder), many, cold_start=policy, week_anchor=anchor)) == expected
    calls = read_calls_folder(spark, str(folder))
    assert rows(metrics_of_days(calls, policy, week_anchor=anchor)) == expected
    assert {r.metric_name for r in load_unified(spark, one, "baseline").collect()} <= set(ca.BASELINE_METRICS)


def test_first_days_grow_only_where_they_are_written(spark, folder, tmp_path, monkeypatch):
    """Without other days in the table, no grown rows are stored on the way; with some, the result is that of all at once."""
    stored, write = {}, plans.materialise

    def kept(df, name):
        stored[name] = write(df, name)
        return stored[name]

    monkeypatch.setattr(plans, "materialise", kept)
    calls = read_calls_folder(spark, str(folder))
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    expected = rows(plans.add_days(spark, calls, whole))
    assert [n for n, df in stored.items() if {"metric_value", "week_start_date"} & {*df.columns}] == []
    late = F.col("source_file").endswith("calls_03.csv")
    plans.add_days(spark, calls.where(~late), parts)
    assert rows(plans.add_days(spark, calls.where(late), parts)) == expected


def test_files_of_a_day_are_one_day(spark, folder, tmp_path):
    """A second file adds to its day, in any order, and reading either again changes nothing."""
    write_csv(folder / "calls_04.csv", ["zed,Z,x,2024-01-15 02:00:00", "alice,A,x,2024-01-15 09:30:00"])
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    expected = rows(backfill(spark, str(folder), whole))
    for name in ("calls_01.csv", "calls_02.csv", "calls_04.csv", "calls_03.csv"):
        last = run_daily(spark, str(folder / name), parts)
    assert rows(last) == expected
    for name in ("calls_04.csv", "calls_03.csv"):
        assert rows(run_daily(spark, str(folder / name), parts)) == expected
    assert rows(metrics_of_days(read_calls_folder(spark, str(folder)))) == expected
    day = load_unified(spark, parts).where((F.col("date") == "2024-01-15") & (F.col("metric_name") == "total calls volume"))
    before = metrics_of_days(read_calls_folder(spark, str(folder)).where(~F.col("source_file").endswith("calls_04.csv"))).where(
        (F.col("date") == "2024-01-15") & (F.col("metric_name") == "total calls volume"))
    calls_of = lambda df: {r.user: r.n for r in df.groupBy("user").agg(F.sum("metric_value").alias("n")).collect()}
    one, two = calls_of(before), calls_of(day)
    assert two["zed"] == 1.0 and two["alice"] == one.get("alice", 0.0) + 1


def spoil(out, before):
    """Overwrite the daily partitions of dates before ``before`` with bytes that cannot be read."""
    for folder in (out / "metric_family=daily").iterdir():
        if folder.name < f"date={before}":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"unreadable")
                (folder / f".{file.name}.crc").unlink(missing_ok=True)


def test_a_day_reads_no_older_week(spark, folder, tmp_path):
    """Within a week no daily row is read for the averages, and a new week reads those of the week before."""
    out = tmp_path / "out"
    for name in sorted(WEEKS):
        run_daily(spark, str(folder / name), str(out))
    write_csv(folder / "calls_05.csv", ["bob,B,manual,2024-01-16 09:00:00", "alice,A,x,2024-01-16 09:30:00"])
    write_csv(folder / "calls_06.csv", ["bob,B,manual,2024-01-22 11:00:00", "alice,A,x,2024-01-22 09:30:00"])
    expected = backfill(spark, str(folder), str(tmp_path / "whole"))

    def new_rows(table, day):
        chosen = (F.col("date") == day) | F.col("metric_name").isin(ca.BASELINE_METRICS)
        return rows(table.where(chosen)) if table is expected else rows(
            spark.read.schema(UNIFIED).option("basePath", str(out)).parquet(
                str(out / "metric_family=baseline"), *map(str, out.glob(f"*/date={day}"))).select(*UNIFIED_COLUMNS))

    spoil(out, "2024-01-16")
    run_daily(spark, str(folder / "calls_05.csv"), str(out))
    before = backfill(spark, str(folder), str(tmp_path / "before"), glob="calls_0[1-5].csv")
    chosen = (F.col("date") == "2024-01-16") | F.col("metric_name").isin(ca.BASELINE_METRICS)
    assert new_rows(None, "2024-01-16") == rows(before.where(chosen))
    fresh = tmp_path / "fresh"
    for name in ("calls_01.csv", "calls_02.csv", "calls_03.csv", "calls_05.csv"):
        run_daily(spark, str(folder / name), str(fresh))
    spoil(fresh, "2024-01-15")
    run_daily(spark, str(folder / "calls_06.csv"), str(fresh))
    out = fresh
    assert new_rows(None, "2024-01-22") == new_rows(expected, "2024-01-22")


@pytest.mark.parametrize("step", ["save_shares", "save_state", "save_unified", "save_baseline_snapshot"])
@pytest.mark.parametrize("done", [False, True])
def test_a_job_that_ends_between_writes_is_repaired_by_the_next(spark, folder, tmp_path, monkeypatch, step, done):
    expected = rows(backfill(spark, str(folder), str(tmp_path / "whole")))
    out = str(tmp_path / "out")
    for name in ("calls_01.csv", "calls_02.csv"):
        run_daily(spark, str(folder / name), out)
    write = getattr(plans, step)

    def broken(*args):
        if done:
            write(*args)
        raise RuntimeError("ended")

    with monkeypatch.context() as patch:
        patch.setattr(plans, step, broken)
        with pytest.raises(RuntimeError):
            run_daily(spark, str(folder / "calls_03.csv"), out)
    assert rows(run_daily(spark, str(folder / "calls_03.csv"), out)) == expected


def test_a_late_file_changes_the_averages(spark, folder, tmp_path):
    """A file of a week behind the running state is part of the averages of the next day."""
    out = str(tmp_path / "out")
    for name in sorted(WEEKS):
        run_daily(spark, str(folder / name), out)
    write_csv(folder / "calls_00.csv", ["alice,A,manual,2024-01-08 09:30:00", "zed,Z,x,2024-01-08 01:00:00"])
    write_csv(folder / "calls_05.csv", ["alice,A,manual,2024-01-22 09:30:00"])
    run_daily(spark, str(folder / "calls_00.csv"), out)
    last = run_daily(spark, str(folder / "calls_05.csv"), out)
    whole = backfill(spark, str(folder), str(tmp_path / "whole"))
    chosen = (F.col("date") == "2024-01-22") | F.col("metric_name").isin(ca.BASELINE_METRICS)
    assert rows(last.where(chosen)) == rows(whole.where(chosen))


def test_week_matrices_of_counters_and_of_rows(spark, folder):
    calls = read_calls_folder(spark, str(folder))
    counters, daily = ca.hour_counters(calls), ca.daily_rows(calls)
    base = ca.baseline(daily, "2024-01-15")
    today = ca.deviations(daily.where("date = '2024-01-15'"), base)
    for measure, (_, average, deviation) in ca.METRICS.items():
        assert rows(hm.average_week(counters, "2024-01-15", measure)) == rows(hm.average_matrix(base, average))
        assert rows(hm.deviation_week(counters, "2024-01-15", "2024-01-15", measure)) == rows(hm.deviation_matrix(today, "2024-01-15", deviation))
    assert "Generate" not in plan(hm.average_week(counters, "2024-01-15"))
    sorted_rows = [(r.user, r.metric_name, r.index_value) for r in ca.sort_metrics(base).collect()]
    assert sorted_rows == sorted(sorted_rows) and len(sorted_rows) == base.count()


def test_missing_unified_table_is_empty(spark, tmp_path):
    empty = load_unified(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and "n_weeks" in empty.columns


def test_busy_user_and_file(spark):
    """A third of all calls from one user in one file."""
    base = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 50).cast("string"))).alias("user"),
        F.lit("x").alias("id_chat"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id") % 86400)).cast("timestamp_ntz").alias("dttm"),
        F.lit("f").alias("source_file"))
    got = ca.daily_rows(base).where("metric_name = 'total calls volume'").groupBy("user").agg(F.sum("metric_value").alias("n"))
    assert dict(rows(got))["hot"] == 10000.0
    assert sum(n for _, n in rows(got)) == 30000.0


def test_deviations_join_only_the_hours_of_the_day(spark):
    """Averages of other hours are left out of the join, but count as history."""
    daily = spark.createDataFrame([("a", ca.DAILY_METRICS[0], 5.0, 3, None, None, None), ("b", ca.DAILY_METRICS[0], 1.0, 3, None, None, None)], UNIFIED)
    for hour in (3, 99):
        base = spark.createDataFrame([("a", ca.BASELINE_METRICS[0], 2.0, hour, None, None, 1)], UNIFIED)
        for policy in ca.COLD_START_POLICIES:
            assert rows(ca.deviations(daily, base, policy, hours=[3])) == rows(ca.deviations(daily, base, policy))


def scattered_calls(spark, n=600):
    rng = random.Random(3)
    log = []
    for k in range(n):
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 24))
        log.append((rng.choice(["a", "b", None, "d"]), day + dt.timedelta(hours=rng.randint(0, 30)), rng.choice(["Manual call", "x", None]), f"{day}-{k % 3}"))
    log += [("z", None, "x", "no times")] * 2 + [("a", None, "x", "no times")]
    return spark.createDataFrame(log, "user string, dttm timestamp, id_chat string, source_file string")


@pytest.mark.parametrize("anchor", ["monday", "tuesday"])
def test_counters_give_the_same_deviations_and_averages_as_rows(spark, anchor):
    counters = ca.hour_counters(scattered_calls(spark)).cache()
    daily = ca.rows_of_counters(counters, anchor).cache()
    weeks = sorted({r[0] for r in daily.select("week_start_date").distinct().collect() if r[0]})
    for policy, active in (("suppress", True), ("zero", False), ("nan", True)):
        expected = rows(ca.historic_deviations(daily, policy, active))
        assert expected and rows(ca.counter_deviations(counters, policy, active, weeks[0], anchor)) == expected
    expected = rows(ca.baseline(daily, weeks[-1]))
    assert expected and rows(ca.counter_baseline(counters, weeks[-1], anchor)) == expected


def test_days_grow_behind_windows_and_sums(spark):
    """No window, sum or shuffle takes the 72 rows of each day."""
    shown = plan(metrics_of_days(scattered_calls(spark)))
    branches = re.split("Scan parquet", shown)[:-1]
    assert len(branches) == 3
    for branch in branches:
        steps = re.findall(r"(Generate|Window|HashAggregate|SortAggregate|Exchange|Sort) ", branch)
        assert set(steps[:len(steps) - steps[::-1].index("Generate")]) == {"Generate"}
