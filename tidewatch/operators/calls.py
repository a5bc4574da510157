"""Hourly call metrics per user: daily rows, historic averages, deviations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_manual, week_start
from ..functions.text import MANUAL_PATTERN
from ..schemas import require_columns
from ..session import spread

# Metric names, (daily, average, deviation) per measure.
METRICS = {
    "total_calls": ("total calls volume", "average total calls", "total calls deviation"),
    "manual_calls": ("total manual call volume", "average manual calls", "manual calls deviation"),
    "active_status": ("user active status", "average user status", "user status deviation"),
}
DAILY_METRICS = [names[0] for names in METRICS.values()]
BASELINE_METRICS = [names[1] for names in METRICS.values()]
DEVIATION_METRICS = [names[2] for names in METRICS.values()]
COLD_START_POLICIES = ("suppress", "zero", "nan")


def metric_family(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return (
        F.when(name.isin(DAILY_METRICS), "daily")
        .when(name.isin(BASELINE_METRICS), "baseline")
        .when(name.isin(DEVIATION_METRICS), "deviation")
    )


def _rename(name: Column, position: int) -> Column:
    """Map a daily metric name to its average (1) or deviation (2) name."""
    out = F.lit(None).cast("string")
    for names in METRICS.values():
        out = F.when(name == names[0], names[position]).otherwise(out)
    return out


def file_days(calls: DataFrame) -> DataFrame:
    """The day of each source file: the date of its latest call."""
    return calls.groupBy("source_file").agg(F.to_date(F.max("dttm")).alias("date"))


def hour_counters(
    calls: DataFrame, pattern: str = MANUAL_PATTERN, days: DataFrame | None = None, by_file: bool = False
) -> DataFrame:
    """Per file day and user: calls and manual calls of its 24 hours, as two arrays.

    Several files of one day are added up; ``by_file`` keeps them apart.

    ``calls`` needs user, dttm, id_chat and source_file. Every user in a file
    has a row, also when their calls fall on other days. Calls are counted
    before anything is shuffled or joined, so only rows per file, user and date
    move, and a very large file is no burden to one task.
    """
    require_columns(calls, ["user", "dttm", "id_chat", "source_file"], "calls")
    days = file_days(calls) if days is None else days
    names = [f"{kind}{h}" for kind in "tm" for h in range(24)]
    hour, manual = F.hour("dttm"), is_manual("id_chat", pattern)
    counts = [F.count_if(hour == h).alias(f"t{h}") for h in range(24)]
    counts += [F.count_if((hour == h) & manual).alias(f"m{h}") for h in range(24)]
    counted = calls.groupBy("source_file", "user", F.to_date("dttm").alias("call_date")).agg(*counts)
    of_day = F.col("call_date") == F.col("date")
    keys = ["source_file", "date", "user"] if by_file else ["date", "user"]
    summed = spread(counted.join(days, "source_file"), "user").groupBy(*keys).agg(*[
        F.sum(F.when(of_day, F.col(n)).otherwise(0)).alias(n) for n in names
    ])
    return summed.select(
        *keys, F.array(*names[:24]).alias("totals"), F.array(*names[24:]).alias("manuals")
    )


def add_counters(shares: DataFrame) -> DataFrame:
    """Counters per day and user from those of the day's files."""
    summed = spread(shares, "user").groupBy("date", "user").agg(*[
        F.sum(F.col(kind)[h]).alias(f"{kind}{h}") for kind in ("totals", "manuals") for h in range(24)
    ])
    return summed.select("date", "user", *[
        F.array(*[f"{kind}{h}" for h in range(24)]).alias(kind) for kind in ("totals", "manuals")
    ])


def _hourly_rows(days: DataFrame, week_anchor: str, **values: dict[str, Column]) -> DataFrame:
    """The 72 rows (24 hours, three metrics) of each day and user; ``values`` name a column each, by metric as arrays of 24."""
    by_hour = days.select(
        "user", "date", week_start("date", week_anchor).alias("week_start_date"),
        (F.weekday("date") * 24 + 1).alias("first_index"),
        *[of[key].alias(f"{name}_{key}") for name, of in values.items() for key in METRICS],
        F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"),
    )
    measures = F.array(*[
        F.struct(F.lit(METRICS[key][0]).alias("metric_name"), *[F.col(f"{name}_{key}")[F.col("h")].alias(name) for name in values])
        for key in METRICS
    ])
    return by_hour.select(
        "user", F.inline(measures), (F.col("first_index") + F.col("h")).alias("index_value"),
        "week_start_date", "date", F.lit(None).cast("int").alias("n_weeks"),
    )


def rows_of_counters(counters: DataFrame, week_anchor: str = "monday") -> DataFrame:
    """The 72 metric rows (24 hours, three metrics) of each day and user."""
    return _hourly_rows(counters, week_anchor, metric_value={key: measure_of_counters(key) for key in METRICS})


def daily_rows(
    calls: DataFrame, pattern: str = MANUAL_PATTERN, week_anchor: str = "monday",
    days: DataFrame | None = None,
) -> DataFrame:
    """Metric rows for each user of each source file and each hour of its day.

    The grid comes from 24 counters per user and file, with no grid join. Rows
    are partitioned by user (a user has one row per day before they grow), so
    later steps by user need no shuffle of the grown rows.
    """
    return rows_of_counters(hour_counters(calls, pattern, days), week_anchor)


def _prior_weeks(unified: DataFrame, as_of_week) -> DataFrame:
    week = F.col("week_start_date")
    return unified.where(
        F.col("metric_name").isin(DAILY_METRICS) & week.isNotNull() & (week < F.lit(as_of_week).cast("date"))
    )


STATE_KEYS = ["user", "index_value", "metric_name"]
STATE = "user STRING, index_value INT, metric_name STRING, total DOUBLE, n_weeks LONG"


def weekly_state(unified: DataFrame, as_of_week) -> DataFrame:
    """Sum of weekly values and number of weeks per user, hour of week and metric, over weeks before ``as_of_week``.

    States of different weeks merge by adding, so a day need not read the
    history behind a stored state. Both grouping steps run without a shuffle
    when rows come partitioned by user, as ``daily_rows`` leaves them.
    """
    weekly = (
        _prior_weeks(unified, as_of_week)
        .groupBy(*STATE_KEYS, "week_start_date").agg(F.sum("metric_value").alias("metric_value"))
    )
    return weekly.groupBy(*STATE_KEYS).agg(F.sum("metric_value").alias("total"), F.count("metric_value").alias("n_weeks"))


def merged_states(one: DataFrame, two: DataFrame) -> DataFrame:
    """The state of the weeks of both, which must be different weeks."""
    return one.unionByName(two).groupBy(*STATE_KEYS).agg(F.sum("total").alias("total"), F.sum("n_weeks").alias("n_weeks"))


def averages_of_state(state: DataFrame) -> DataFrame:
    """Average rows of a state."""
    return state.select(
        "user", _rename(F.col("metric_name"), 1).alias("metric_name"), F.try_divide("total", "n_weeks").alias("metric_value"), "index_value",
        F.lit(None).cast("date").alias("week_start_date"), F.lit(None).cast("date").alias("date"),
        F.col("n_weeks").cast("int").alias("n_weeks"),
    )


def baseline(unified: DataFrame, as_of_week) -> DataFrame:
    """Average per user, hour of week and metric over weeks before ``as_of_week``."""
    return averages_of_state(weekly_state(unified, as_of_week))


def measure_of_counters(measure: str) -> Column:
    """The 24 values of a measure as doubles."""
    counts = F.col("manuals" if measure == "manual_calls" else "totals")
    if measure == "active_status":
        return F.transform(counts, lambda n: (n > 0).cast("double"))
    return F.transform(counts, lambda n: n.cast("double"))


def hour_averages(counters: DataFrame, as_of_week, measure: str, week_anchor: str = "monday") -> DataFrame:
    """Per user and weekday (0 is Monday): ``averages`` of the 24 hours over weeks before ``as_of_week``.

    A weekday of a week is one date, so the counters of a date are that week's
    values, and 24 sums and a count replace the rows of every hour.
    """
    before = counters.where(week_start("date", week_anchor) < F.lit(as_of_week).cast("date"))
    values = before.select("user", F.weekday("date").alias("weekday"), measure_of_counters(measure).alias("value"))
    summed = values.groupBy("user", "weekday").agg(F.count("*").alias("n"), *[F.sum(F.col("value")[h]).alias(f"h{h}") for h in range(24)])
    return summed.select("user", "weekday", F.array(*[F.col(f"h{h}") / F.col("n") for h in range(24)]).alias("averages"))


def hour_deviations(counters: DataFrame, averages: DataFrame, day, measure: str) -> DataFrame:
    """Per user of ``day`` with an average for its weekday: ``deviations`` of the 24 hours."""
    today = counters.where(F.col("date") == F.lit(day).cast("date")).select(
        "user", F.weekday("date").alias("weekday"), measure_of_counters(measure).alias("value"))
    return today.join(averages, ["user", "weekday"]).select(
        "user", "weekday", F.zip_with("value", "averages", lambda a, b: a - b).alias("deviations"))


def _check_policy(cold_start: str) -> None:
    if cold_start not in COLD_START_POLICIES:
        raise ValueError(f"cold_start must be one of {COLD_START_POLICIES}")


def _apply_cold_start(
    rows: DataFrame, has_history: Column, average: Column, cold_start: str, include_active: bool
) -> DataFrame:
    """Turn daily rows joined to averages into deviation rows.

    Without any history the policy decides for all three metrics; with some,
    a missing key is dropped ("suppress") or left null.
    """
    status = METRICS["active_status"][0]
    no_history_value = F.lit(0.0) if cold_start == "zero" else F.lit(None).cast("double")
    value = F.when(has_history, F.col("metric_value") - average).otherwise(no_history_value)
    kept = rows
    if not include_active:
        kept = kept.where(~has_history | (F.col("metric_name") != status))
    out = kept.select(
        "user", _rename(F.col("metric_name"), 2).alias("metric_name"), value.alias("metric_value"),
        "index_value", "week_start_date", "date", F.lit(None).cast("int").alias("n_weeks"),
    )
    return out.where(F.col("metric_value").isNotNull()) if cold_start == "suppress" else out


def deviations(
    daily: DataFrame, base: DataFrame, cold_start: str = "suppress", include_active: bool = True,
    hours: list[int] | None = None,
) -> DataFrame:
    """Daily value minus historic average, per user, hour of week and metric.

    ``hours`` are the hours of the week in ``daily``, if they are known: other averages are not joined.
    """
    _check_policy(cold_start)
    of_hours = base if hours is None else base.where(F.col("index_value").isin(hours))
    averages = of_hours.select(
        "user", "index_value", F.col("metric_name").alias("average_name"),
        F.col("metric_value").alias("average"),
    )
    any_average = base.limit(1).agg((F.count("*") > 0).alias("any")).scalar()
    joined = daily.withColumn("average_name", _rename(F.col("metric_name"), 1)).join(
        averages, ["user", "index_value", "average_name"], "left"
    )
    return _apply_cold_start(joined, any_average, F.col("average"), cold_start, include_active)


def historic_deviations(
    daily: DataFrame, cold_start: str = "suppress", include_active: bool = True, first_week=None
) -> DataFrame:
    """Deviations of every day at once, each against the weeks before its own.

    A window over one user, hour and metric holds one row per week, so no
    window grows beyond the number of weeks stored. ``first_week`` saves looking
    for the earliest week in ``daily``.
    """
    _check_policy(cold_start)
    before = (
        Window.partitionBy("user", "index_value", "metric_name").orderBy("week_start_date")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    keys = ["user", "index_value", "metric_name"]
    with_average = daily.withColumn("average", F.avg("metric_value").over(before))
    if first_week is None:
        first_week = daily.agg(F.min("week_start_date").alias("w")).scalar()
    return _apply_cold_start(
        with_average.select(*keys, "metric_value", "week_start_date", "date", "average"),
        F.col("week_start_date") > F.lit(first_week), F.col("average"), cold_start, include_active,
    )


def _hour_values() -> dict[tuple[str, int], Column]:
    """The value of each measure and hour of a row of counters."""
    totals, manuals = F.col("totals"), F.col("manuals")
    values = {("total_calls", h): totals[h] for h in range(24)} | {("manual_calls", h): manuals[h] for h in range(24)}
    return values | {("active_status", h): (totals[h] > 0).cast("int") for h in range(24)}


def counter_deviations(
    counters: DataFrame, cold_start: str, include_active: bool, first_week, week_anchor: str = "monday",
    deal: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``historic_deviations`` of the rows of ``counters``, which grow behind the window.

    A weekday of a week is one date, so a window over one user and weekday holds
    one row per week, and the sums before it are those of its 72 rows. ``deal``
    shuffles the days before they grow.
    """
    _check_policy(cold_start)
    dated = counters.withColumns({"weekday": F.weekday("date"), "week": week_start("date", week_anchor)})
    before = Window.partitionBy("user", "weekday").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    summed = dated.select(
        "user", "date", "totals", "manuals", F.count("*").over(before).alias("n"),
        *[F.sum(value).over(before).alias(f"{key}{h}") for (key, h), value in _hour_values().items()],
    )
    averages = {key: F.array(*[F.try_divide(F.col(f"{key}{h}").cast("double"), F.col("n")) for h in range(24)]) for key in METRICS}
    if deal is not None:
        summed = deal(summed)
    rows = _hourly_rows(
        summed, week_anchor, metric_value={key: measure_of_counters(key) for key in METRICS}, average=averages)
    return _apply_cold_start(
        rows, F.col("week_start_date") > F.lit(first_week), F.col("average"), cold_start, include_active)


def counter_baseline(counters: DataFrame, as_of_week, week_anchor: str = "monday") -> DataFrame:
    """``baseline`` of the rows of ``counters``."""
    return averages_of_state(counter_state(counters, as_of_week, week_anchor))


def counter_state(counters: DataFrame, as_of_week, week_anchor: str = "monday") -> DataFrame:
    """``weekly_state`` of the rows of ``counters``: summed per user and weekday, then grown."""
    prior = counters.where(week_start("date", week_anchor) < F.lit(as_of_week).cast("date"))
    summed = prior.groupBy("user", F.weekday("date").alias("weekday")).agg(
        F.count("*").alias("n_weeks"), *[F.sum(value).cast("double").alias(f"{key}{h}") for (key, h), value in _hour_values().items()])
    by_hour = summed.select("user", "weekday", "n_weeks", *[
        F.array(*[F.col(f"{key}{h}") for h in range(24)]).alias(key) for key in METRICS
    ], F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    totals = F.array(*[
        F.struct(F.lit(METRICS[key][0]).alias("metric_name"), F.col(key)[F.col("h")].alias("total")) for key in METRICS
    ])
    grown = by_hour.select("user", (F.col("weekday") * 24 + 1 + F.col("h")).alias("index_value"), "n_weeks", F.inline(totals))
    return grown.select(*STATE_KEYS, "total", "n_weeks")


def sort_metrics(df: DataFrame) -> DataFrame:
    """Rows by user, metric and hour of the week."""
    return df.orderBy("user", "metric_name", "index_value")
