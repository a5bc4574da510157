"""Exact quantile of a column of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
COLLECT_LIMIT = 100_000


def _value_at(values: DataFrame, rank: int, n: int, collect_limit: int) -> float:
    """The value with ``rank`` values before it in order.

    Approximate percentiles bracket it and counts place it. If it is one of the
    bracket's ends it is found; otherwise the search goes on strictly between
    them. At most ``collect_limit`` values are ordered in the end.
    """
    current, before, inside = values, 0, n
    margin = 2 / ACCURACY
    while inside > collect_limit:
        share = (rank - before) / inside
        bounds = [max(share - margin, 0.0), min(share + margin, 1.0)]
        low, high = current.agg(F.percentile_approx("v", bounds, ACCURACY)).first()[0]
        below_low, up_to_low, below_high, up_to_high = values.agg(
            F.count_if(F.col("v") < low), F.count_if(F.col("v") <= low),
            F.count_if(F.col("v") < high), F.count_if(F.col("v") <= high),
        ).first()
        if not below_low <= rank < up_to_high:
            margin *= 4
        elif rank < up_to_low:
            return low
        elif rank >= below_high:
            return high
        else:
            current = values.where((F.col("v") > low) & (F.col("v") < high))
            before, inside = up_to_low, below_high - up_to_low
    return current.orderBy("v").offset(rank - before).limit(1).first()[0]


def exact_quantile(df: DataFrame, column: str, q: float, collect_limit: int = COLLECT_LIMIT) -> float:
    """Quantile ``q`` with linear interpolation between neighbouring values."""
    values = df.select(F.col(column).cast("double").alias("v"))
    n = values.count()
    if n == 0:
        raise ValueError("quantile of an empty table")
    position = q * (n - 1)
    rank = math.floor(position)
    value = _value_at(values, rank, n, collect_limit)
    if rank == position:
        return value
    up_to, above = values.agg(
        F.count_if(F.col("v") <= value), F.min(F.when(F.col("v") > value, F.col("v")))
    ).first()
    following = value if up_to > rank + 1 else above
    return value + (following - value) * (position - rank)
