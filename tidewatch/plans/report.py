"""The report's date filter and drill-downs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stringify_ts
from ..operators.report import account_drill, attach_unique_accounts, filter_range, user_drill, users_by_day


def date_filter(report: DataFrame, start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """Rows in range and their users-by-day table, times as text."""
    rows = filter_range(report, start, end)
    table = stringify_ts(users_by_day(rows), ("first_seen", "last_seen"))
    return stringify_ts(rows, ("dttm",)), table


def user_drill_in_range(calls: DataFrame, user: str, start=None, end=None) -> DataFrame:
    """One user's rows in a range of whole days, with their accounts per day.

    A user's counts need only that user's rows, so name and range reach the scan.
    """
    return user_drill(attach_unique_accounts(filter_range(calls, start, end).where(F.col("user") == F.lit(user))), user)


def account_drill_in_range(calls: DataFrame, account: str, start=None, end=None) -> DataFrame:
    """One account's rows in a range of whole days, with the accounts per day of their users.

    Only the users and dates of the account's rows are counted.
    """
    ranged = filter_range(calls, start, end).withColumn("date", F.to_date("dttm"))
    mine = ranged.where(F.col("account") == F.lit(account))
    counted = ranged.join(mine.select("user", "date").distinct(), ["user", "date"], "left_semi")
    counts = counted.groupBy("user", "date").agg(F.count_distinct("account").alias("num_of_unique_suspicious_accounts"))
    return account_drill(mine.join(counts, ["user", "date"], "left"), account)
