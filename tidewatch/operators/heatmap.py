"""Hour-of-week matrices for users, roles and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid_day, grid_hour, hour_of_week, parse_ts
from ..functions.scores import ratio_or_zero
from .calls import hour_averages, hour_deviations

NORMALISATIONS = ("none", "global", "row", "col")
HOURS = 168


def user_hour_matrix(rows: DataFrame) -> DataFrame:
    """Users by hours 1..168, first non-null value per cell, 0 where there is none."""
    hours = list(range(1, HOURS + 1))
    wide = rows.where(F.col("user").isNotNull()).groupBy("user").pivot("index_value", hours).agg(F.first("metric_value", ignorenulls=True))
    return wide.fillna(0.0).orderBy("user")


def average_matrix(unified: DataFrame, metric: str) -> DataFrame:
    return user_hour_matrix(unified.where(F.col("metric_name") == metric))


def deviation_matrix(unified: DataFrame, day: str, metric: str) -> DataFrame:
    chosen = (F.col("metric_name") == metric) & (F.col("date") == F.lit(day).cast("date"))
    return user_hour_matrix(unified.where(chosen))


def week_matrix(cells: DataFrame, values: str) -> DataFrame:
    """Users by hours 1..168 from rows of (user, weekday, array of 24 values), 0 where there is none.

    A user has at most seven rows, and the cells are read from their arrays;
    nothing grows to a row per hour.
    """
    held = cells.groupBy("user").agg(F.map_from_entries(F.collect_list(F.struct("weekday", values))).alias("days"))
    hour = [F.coalesce(F.col("days")[d][h], F.lit(0.0)).alias(str(24 * d + h + 1)) for d in range(7) for h in range(24)]
    return held.where(F.col("user").isNotNull()).select("user", *hour).orderBy("user")


def average_week(counters: DataFrame, as_of_week, measure: str = "total_calls") -> DataFrame:
    """The matrix of averages as of a week, straight from the counters of days."""
    return week_matrix(hour_averages(counters, as_of_week, measure), "averages")


def deviation_week(counters: DataFrame, as_of_week, day, measure: str = "total_calls") -> DataFrame:
    """The matrix of a day's deviations, straight from the counters of days."""
    averages = hour_averages(counters, as_of_week, measure)
    return week_matrix(hour_deviations(counters, averages, day, measure), "deviations")


def role_events(log: DataFrame, role: str | None = None) -> DataFrame:
    """Log rows with a readable time, of one role if given, with their 0-based hour of week."""
    rows = log.where(F.col("account_type") == role) if role else log
    timed = rows.withColumn("timestamp", parse_ts("timestamp")).where(F.col("timestamp").isNotNull())
    return timed.withColumn("hour_of_week", hour_of_week("timestamp", base=0))


def dense_hours(counts: DataFrame, keys: list[str], value: str = "n", asked: DataFrame | None = None) -> DataFrame:
    """Give every key all 168 hours, absent ones 0; ``asked`` names keys that may have no row at all.

    ``counts`` has at most one row per key and hour, so the per-key map that
    fills the gaps never holds more than 168 entries.
    """
    entry = F.struct(F.col("hour_of_week"), F.col(value))
    filled = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("by_hour"))
    if asked is not None:
        filled = asked.select(*keys).distinct().join(filled, keys, "left")
    zero = F.lit(0).cast(counts.schema[value].dataType)
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(HOURS - 1)),
        lambda h: F.struct(h.alias("hour_of_week"), F.coalesce(F.col("by_hour")[h], zero).alias(value)),
    )
    return filled.select(*keys, F.inline(cells))


def hour_counts(events: DataFrame, keys: list[str], asked: DataFrame | None = None) -> DataFrame:
    """Events per key and hour of week over all 168 hours."""
    counts = events.groupBy(*keys, "hour_of_week").agg(F.count("*").alias("n"))
    return dense_hours(counts, keys, asked=asked)


def _roles(log: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    return log.sparkSession.createDataFrame([(r,) for r in roles], "account_type string")


def normalize_grid(grid: DataFrame, mode: str, keys: list[str], value: str = "n") -> DataFrame:
    """Scale a (keys, day, hour) grid: by its maximum, by day sums, by hour maxima, or not.

    A zero divisor leaves the zeros as they are.
    """
    if mode not in NORMALISATIONS:
        raise ValueError(f"normalize must be one of {NORMALISATIONS}")
    v = F.col(value).cast("double")
    if mode == "none":
        return grid.withColumn(value, v)
    divisor = {
        "global": lambda: F.max(v).over(Window.partitionBy(*keys)),
        "row": lambda: F.sum(v).over(Window.partitionBy(*keys, "day")),
        "col": lambda: F.max(v).over(Window.partitionBy(*keys, "hour")),
    }[mode]()
    return grid.withColumn(value, ratio_or_zero(v, F.nullif(divisor, F.lit(0.0))))


def _grid(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.select(*keys, grid_day("hour_of_week").alias("day"), grid_hour("hour_of_week").alias("hour"), "n")


def role_heatmap(log: DataFrame, role: str = "human", normalize: str = "global") -> DataFrame:
    """7 x 24 usage of one role, all 0 if it has no events, as rows (account_type, day, hour, n)."""
    counts = hour_counts(role_events(log, role), ["account_type"], _roles(log, (role,)))
    return normalize_grid(_grid(counts, ["account_type"]), normalize, ["account_type"])


def compare_roles(log: DataFrame, normalize: str = "global", roles: tuple[str, ...] = ("human", "functional")) -> DataFrame:
    """Role heatmaps side by side in long form, each role scaled alone."""
    events = role_events(log.where(F.col("account_type").isin(*roles)))
    counts = hour_counts(events, ["account_type"], _roles(log, roles))
    return normalize_grid(_grid(counts, ["account_type"]), normalize, ["account_type"])


def top_users(log: DataFrame, role: str = "human", n: int = 6) -> DataFrame:
    """The ``n`` users of a role with most events; ties go to the lower name."""
    known = role_events(log, role).where(F.col("user").isNotNull())
    counts = known.groupBy("user").agg(F.count("*").alias("events"))
    return counts.orderBy(F.desc("events"), "user").limit(n)


def top_user_heatmaps(log: DataFrame, role: str = "human", n: int = 6, normalize: str = "global") -> DataFrame:
    """Heatmaps of the role's busiest users, each user scaled alone."""
    events = role_events(log, role).where(F.col("user").isNotNull())
    by_hour = events.groupBy("user", "hour_of_week").agg(F.count("*").alias("n"))
    chosen = by_hour.groupBy("user").agg(F.sum("n").alias("events")).orderBy(F.desc("events"), "user").limit(n)
    counts = dense_hours(by_hour.join(chosen.select("user"), "user", "left_semi"), ["user"])
    return normalize_grid(_grid(counts, ["user"]), normalize, ["user"])


def with_cluster(log: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach command clusters to log rows; unknown commands keep a null cluster."""
    return log.join(labels.select("command", "cluster"), "command", "left")


def cluster_usage(log: DataFrame, labels: DataFrame) -> DataFrame:
    """7 x 24 usage per command cluster, divided by the cluster's busiest cell.

    Counting per command before attaching the labels keeps the join small.
    """
    by_command = role_events(log).groupBy("command", "hour_of_week").agg(F.count("*").alias("n"))
    labelled = with_cluster(by_command, labels).where(F.col("cluster").isNotNull())
    by_cluster = labelled.groupBy("cluster", "hour_of_week").agg(F.sum("n").alias("n"))
    counts = dense_hours(by_cluster, ["cluster"])
    return normalize_grid(_grid(counts, ["cluster"]), "global", ["cluster"])


def cluster_hour_mean(profile: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean normalised pattern per cluster from dense (command, hour, share) rows."""
    labelled = profile.join(labels.select("command", "cluster"), "command")
    return labelled.groupBy(
        "cluster", grid_day("hour_of_week").alias("day"), grid_hour("hour_of_week").alias("hour")
    ).agg(F.avg("share").alias("share"))
