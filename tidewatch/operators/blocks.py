"""All-against-all work split into equal blocks.

Rows are dealt into blocks by hash, and each unordered pair (or triple) of
blocks becomes one group. A group holds a bounded number of rows whatever the
skew of the data, so a feature or user shared by most rows is spread over many
tasks, and no row pairs are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_blocks(
    df: DataFrame, keys: list[str], identity: list[str], size: int, fewest: int = 1, smallest: int = 1
) -> DataFrame:
    """Add ``block`` and ``n_blocks``: about ``size`` rows per block within each key.

    There are at least ``fewest`` blocks, as far as these have about ``smallest`` rows.
    """
    rows = F.count("*")
    count = F.greatest(F.ceil(rows / size), F.least(F.ceil(rows / smallest), F.lit(fewest)), F.lit(1)).cast("int")
    if keys:
        sized = df.join(df.groupBy(*keys).agg(count.alias("n_blocks")), keys)
    else:
        sized = df.withColumn("n_blocks", df.agg(count.alias("n_blocks")).scalar())
    return sized.withColumn("block", F.pmod(F.xxhash64(*identity), F.col("n_blocks")).cast("int"))


def _all_blocks(start: Column | int = 0) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    return F.explode(F.sequence(start, F.col("n_blocks") - 1))


def block_pairs(blocked: DataFrame) -> DataFrame:
    """Copy each row to every unordered pair (i <= j) of blocks that holds its own."""
    return (
        blocked.withColumn("other", _all_blocks())
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .drop("other", "n_blocks")
    )


def block_triples(blocked: DataFrame) -> DataFrame:
    """Copy each row to every unordered triple (i <= j <= k) of blocks that holds its own."""
    triple = F.array_sort(F.array("block", "other", "third"))
    return (
        blocked.withColumn("other", _all_blocks())
        .withColumn("third", _all_blocks(F.col("other")))
        .withColumn("triple", triple)
        .withColumns({n: F.col("triple")[p] for p, n in enumerate("ijk")})
        .drop("other", "third", "triple", "n_blocks")
    )
