"""Suspicious-activity report: ranges, users by day, drill-downs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stringify_ts


def date_bounds(report: DataFrame) -> DataFrame:
    """One row: first and last date present, and the default range (the last date)."""
    return report.agg(
        F.to_date(F.min("dttm")).alias("min_date"), F.to_date(F.max("dttm")).alias("max_date")
    ).select(
        "min_date", "max_date",
        F.col("max_date").alias("default_start"), F.col("max_date").alias("default_end"),
    )


def filter_range(report: DataFrame, start=None, end=None) -> DataFrame:
    """Rows from ``start`` to the last microsecond of ``end``.

    If either is missing the range is the last date present. Both bounds are
    plain comparisons on ``dttm``, so they reach the scan.
    """
    if not start or not end:
        start = end = report.agg(F.to_date(F.max("dttm")).alias("d")).scalar()
    else:
        start, end = F.lit(start).cast("date"), F.lit(end).cast("date")
    return report.where(
        (F.col("dttm") >= start.cast("timestamp_ntz"))
        & (F.col("dttm") < F.date_add(end, 1).cast("timestamp_ntz"))
    )


def users_by_day(report: DataFrame, ordered: bool = True) -> DataFrame:
    """Per user and date: distinct accounts that day, and over the whole range the
    user's active days and first and last call.

    Range-wide values are windows over the (user, date) rows, at most one per
    day, not over calls.
    """
    per_day = report.where(F.col("user").isNotNull()).groupBy("user", F.to_date("dttm").alias("date")).agg(
        F.count_distinct("account").alias("suspicious_accounts_for_day"),
        F.min("dttm").alias("day_first"), F.max("dttm").alias("day_last"),
    )
    user = Window.partitionBy("user")
    out = per_day.select(
        "date", "user", "suspicious_accounts_for_day",
        F.count("*").over(user).alias("active_days"),
        F.min("day_first").over(user).alias("first_seen"),
        F.max("day_last").over(user).alias("last_seen"),
    )
    if not ordered:
        return out
    return out.orderBy(F.desc("date"), F.desc("suspicious_accounts_for_day"), "user")


def attach_unique_accounts(calls: DataFrame) -> DataFrame:
    """Add the number of distinct accounts of each row's user and date."""
    dated = calls if "date" in calls.columns else calls.withColumn("date", F.to_date("dttm"))
    counts = dated.groupBy("user", "date").agg(
        F.count_distinct("account").alias("num_of_unique_suspicious_accounts")
    )
    return dated.join(counts, ["user", "date"], "left")


def user_drill(report: DataFrame, user: str) -> DataFrame:
    """One user's rows in time order, times as text."""
    return stringify_ts(report.where(F.col("user") == F.lit(user)).orderBy("dttm"), ("dttm",))


def account_drill(report: DataFrame, account: str) -> DataFrame:
    """All users' rows for one account in time order, times as text."""
    return stringify_ts(report.where(F.col("account") == F.lit(account)).orderBy("dttm"), ("dttm",))
