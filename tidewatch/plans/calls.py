"""Daily call-metric runs on a unified table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import week_start
from ..functions.text import MANUAL_PATTERN
from ..operators.calls import (
    add_counters, averages_of_state, counter_baseline, counter_deviations, counter_state, deviations, file_days, historic_deviations,
    hour_counters, merged_states, rows_of_counters, weekly_state,
)
from ..session import materialise, spread
from ..sources.files import (
    load_shares, load_state, load_unified, read_calls_csv, read_calls_folder, save_baseline_snapshot, save_shares, save_state,
    save_unified,
)

#: Days of users, of 72 rows each and family, that grow in one task.
SLICE = 20_000


def metrics_of_days(
    calls: DataFrame, cold_start: str = "suppress", pattern: str = MANUAL_PATTERN,
    include_active: bool = True, week_anchor: str = "monday",
) -> DataFrame:
    """Daily and deviation rows of all days in ``calls`` and the averages as of the last day.

    The same rows as running the days one after another, in one pass.
    """
    days = file_days(calls)
    # The counters are the smallest form of the days; all parts grow from them.
    counters = spread(materialise(hour_counters(calls, pattern, days), "hour-counters"), "user")
    first_week, last_week = counters.agg(
        F.min(week_start("date", week_anchor)), F.max(week_start("date", week_anchor))
    ).first()
    return (
        rows_of_counters(counters, week_anchor)
        .unionByName(counter_deviations(counters, cold_start, include_active, first_week, week_anchor))
        .unionByName(counter_baseline(counters, last_week, week_anchor))
    )


def _counted_days(spark: SparkSession, calls: DataFrame, out: str, pattern: str) -> DataFrame:
    """Store the files of ``calls`` and return the counters of all days they touch, with the days' other files.

    A file that is read again replaces its own share only.
    """
    shares = materialise(hour_counters(calls, pattern, by_file=True), "file-shares")
    before = load_shares(spark, out).join(shares.select("source_file").distinct(), "source_file", "left_semi")
    dates = materialise(shares.select("date").unionByName(before.select("date")).distinct(), "share-dates")
    save_shares(shares, out)
    touched = load_shares(spark, out).join(dates, "date", "left_semi")
    return materialise(add_counters(touched), "day-counters")


def _history(spark: SparkSession, out: str, daily: DataFrame, since: date | None, until: date) -> DataFrame:
    """Daily rows of weeks from ``since`` up to ``until``: the stored ones, and ``daily`` in place of the dates that it has."""
    # A week begins on its first date, so its partitions are those from that date on.
    inside = F.col("date") < F.lit(until)
    if since is not None:
        inside = inside & (F.col("date") >= F.lit(since))
    stored = load_unified(spark, out, "daily").where(inside)
    stored = stored.join(daily.select("date").distinct(), "date", "left_anti")
    return stored.unionByName(daily.where(inside)).repartition("user")


def _state_as_of(
    spark: SparkSession, out: str, daily: DataFrame, first_week: date, as_of_week: date, week_anchor: str
) -> DataFrame:
    """The running state of all weeks before ``as_of_week``, stored.

    The stored state is taken as it is within its week, and moved on by the
    weeks after it, of which alone daily rows are read. Where ``daily`` changes
    a week behind it (a late file, or an earlier week is asked for) it is added up anew.
    """
    found = load_state(spark, out, week_anchor)
    if found is not None and found[0] <= as_of_week and first_week >= found[0]:
        as_of, state = found
        if as_of == as_of_week:
            return state
        state = merged_states(state, weekly_state(_history(spark, out, daily, as_of, as_of_week), as_of_week))
    else:
        state = weekly_state(_history(spark, out, daily, None, as_of_week), as_of_week)
    state = materialise(state, "week-state")
    save_state(state, out, as_of_week, week_anchor)
    return state


def _by_date(n: int, dates: int) -> Callable[[DataFrame], DataFrame]:
    """Deals ``n`` days of users on ``dates`` dates so that a date lies in few partitions, of about ``SLICE`` rows."""
    slices = max(1, -(-n // (SLICE * max(dates, 1))))
    return lambda days: days.repartition(max(1, slices * dates), "date", F.pmod(F.xxhash64("user"), F.lit(slices)))


def add_day(
    spark: SparkSession, calls: DataFrame, out: str, cold_start: str = "suppress",
    pattern: str = MANUAL_PATTERN, include_active: bool = True, week_anchor: str = "monday",
) -> DataFrame:
    """Add the files of ``calls`` to their day in the unified table and return the table.

    Averages come from a running state of earlier weeks, so the history is not read again.
    """
    counters = _counted_days(spark, calls, out, pattern)
    daily = materialise(rows_of_counters(counters, week_anchor), "daily-rows")
    first_week, as_of_week, hours = daily.agg(
        F.min("week_start_date"), F.max("week_start_date"), F.collect_set("index_value")).first()
    state = _state_as_of(spark, out, daily, first_week, as_of_week, week_anchor)
    base = averages_of_state(state)
    # The averages hold all 168 hours of the week, a day 24 of them.
    found = deviations(daily, base, cold_start, include_active, hours)
    save_unified(daily.unionByName(found), out)
    save_baseline_snapshot(base, out)
    return load_unified(spark, out)


def run_daily(
    spark: SparkSession, csv_path: str, out: str, cold_start: str = "suppress",
    pattern: str = MANUAL_PATTERN, include_active: bool = True, week_anchor: str = "monday",
) -> DataFrame:
    """Add one file to its day in the unified table and return the table.

    Several files of a day add up; running a file again changes nothing.
    """
    return add_day(spark, read_calls_csv(spark, csv_path), out, cold_start, pattern, include_active, week_anchor)


def add_days(
    spark: SparkSession, calls: DataFrame, out: str, cold_start: str = "suppress",
    pattern: str = MANUAL_PATTERN, include_active: bool = True, week_anchor: str = "monday",
) -> DataFrame:
    """Build the unified table from the files of ``calls``, together with days stored before.

    If no other days are stored, all sums and averages come from the counters,
    and the rows of a day grow where they are written.
    """
    counters = _counted_days(spark, calls, out, pattern)
    new_dates = counters.select("date").distinct()
    stored = load_unified(spark, out, "daily").join(new_dates, "date", "left_anti")
    week = week_start("date", week_anchor)
    first_week, last_week, n, dates = counters.agg(F.min(week), F.max(week), F.count("*"), F.count_distinct("date")).first()
    alone = stored.isEmpty()
    if alone:
        deal = _by_date(n, dates)
        found = counter_deviations(counters, cold_start, include_active, first_week, week_anchor, deal)
        state = materialise(counter_state(counters, last_week, week_anchor), "week-state")
        new_metrics = rows_of_counters(deal(counters), week_anchor).unionByName(found)
    else:
        fresh = materialise(rows_of_counters(counters, week_anchor), "daily-rows")
        every_day = stored.unionByName(fresh).repartition("user")
        found = historic_deviations(every_day, cold_start, include_active).join(new_dates, "date", "left_semi")
        state = materialise(weekly_state(every_day, last_week), "week-state")
        new_metrics = materialise(fresh.unionByName(found), "new-metrics")
    save_state(state, out, last_week, week_anchor)
    save_unified(new_metrics, out, dealt=alone)
    save_baseline_snapshot(averages_of_state(state), out)
    return load_unified(spark, out)


def backfill(
    spark: SparkSession, folder: str, out: str, glob: str = "*.csv", cold_start: str = "suppress",
    pattern: str = MANUAL_PATTERN, include_active: bool = True, week_anchor: str = "monday",
) -> DataFrame:
    """Build the unified table from a folder of call files, together with days stored before."""
    return add_days(spark, read_calls_folder(spark, folder, glob), out, cold_start, pattern, include_active, week_anchor)
