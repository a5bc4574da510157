"""Timestamps, days and hours of the week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: times are shown as yyyy-MM-dd HH:mm:ss, the first 19 characters of their text.
DISPLAY_WIDTH = 19


# Forms of time texts beside ISO that are tried in this order; the month comes before the day.
TIME_FORMATS = (
    "M/d/yyyy H:mm[:ss]", "M/d/yyyy h:mm[:ss] a", "M/d/yyyy", "M-d-yyyy H:mm[:ss]", "yyyy/M/d H:mm[:ss]", "yyyy/M/d",
    "yyyyMMddHHmmss", "yyyyMMdd HHmmss", "yyyyMMdd HH:mm:ss", "yyyyMMdd", "d MMM yyyy[ H:mm[:ss]]", "MMM d, yyyy[ H:mm[:ss]]",
    "MMM d, yyyy h:mm[:ss] a",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c: Column | str, *formats: str) -> Column:
    """Timestamp from text, date or timestamp; text that does not parse is null.

    ISO forms are tried first, then ``formats`` (Spark patterns), or else
    ``TIME_FORMATS``. A day before the month needs its format named.
    """
    c = _col(c)
    tries = [c.try_cast("timestamp_ntz")]
    tries += [
        F.try_to_timestamp(F.trim(c.cast("string")), F.lit(f)).cast("timestamp_ntz") for f in formats or TIME_FORMATS
    ]
    return F.coalesce(*tries)


def unreadable_times(df: DataFrame, column: str, *formats: str) -> DataFrame:
    """Time texts of ``column`` that do not parse, with the number of their rows (``n``)."""
    bad = df.where(F.col(column).isNotNull() & parse_ts(column, *formats).isNull())
    return bad.groupBy(column).agg(F.count("*").alias("n"))


def day(c: Column | str) -> Column:
    return F.to_date(_col(c))


def hour_of_week(c: Column | str, base: int = 1) -> Column:
    """Hour counted from Monday 00:00, which is ``base``."""
    c = _col(c)
    return F.weekday(c) * 24 + F.hour(c) + F.lit(base)


def week_start(c: Column | str, anchor: str = "monday") -> Column:
    """First day of the week holding ``c``; weeks begin on ``anchor``."""
    d = F.to_date(_col(c))
    if anchor == "monday":
        return F.trunc(d, "week")
    if anchor == "tuesday":
        return F.next_day(F.date_sub(d, 7), "TU")
    raise ValueError("anchor must be 'monday' or 'tuesday'")


def grid_day(hour0: Column | str) -> Column:
    """Row (0 = Monday) of a 0-based hour of the week in the 7 x 24 grid."""
    return F.floor(_col(hour0) / 24).cast("int")


def grid_hour(hour0: Column | str) -> Column:
    return (_col(hour0) % 24).cast("int")


def stringify_ts(df: DataFrame, columns: tuple[str, ...] = ("dttm", "first_seen", "last_seen")) -> DataFrame:
    """Show the named time columns, where present, as text cut to the second."""
    shown = {c: F.substring(parse_ts(c).cast("string"), 1, DISPLAY_WIDTH) for c in columns if c in df.columns}
    return df.withColumns(shown) if shown else df
