"""Command-similarity anomalies against each user's own history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edit_similarity
from ..functions.scores import ratio_or_zero
from ..session import materialise, spread

Z_THRESHOLD = -2.0
BLOCK_SIZE = 256
# Spread below this share of the mean is rounding noise, not variation.
SPREAD_TOLERANCE = 1e-12
# Scores are compared with the threshold at this many digits: a user with one odd
# command among five scores exactly -2, which noise must not push below -2.
Z_DIGITS = 9


def history_counts(log: DataFrame) -> DataFrame:
    """Each user's past commands with their frequency."""
    return log.groupBy("user", "command").agg(F.count("*").alias("freq"))


def _blocks(n: Column, block_size: int) -> Column:
    return F.ceil(n / F.lit(block_size)).cast("int")


def similarity_pairs(commands: DataFrame, history: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Similarity of each (user, command) to each command of the user's history.

    Both sides of a user are dealt into blocks and meet block by block, so a
    user with very many commands is spread over many tasks.
    """
    n_commands = commands.groupBy("user").agg(_blocks(F.count("*"), block_size).alias("n_left"))
    n_history = history.groupBy("user").agg(_blocks(F.count("*"), block_size).alias("n_right"))
    sizes = n_commands.join(n_history, "user")

    def dealt(df: DataFrame, own: str, other: str, own_n: str, other_n: str) -> DataFrame:
        return (
            df.join(sizes, "user")
            .withColumn(own, F.pmod(F.xxhash64("command"), F.col(own_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
            .drop("n_left", "n_right")
        )

    left = dealt(commands, "lb", "rb", "n_left", "n_right")
    right = dealt(history, "rb", "lb", "n_right", "n_left").withColumnRenamed("command", "past")
    # Work grows with the product of the two sides, not with their bytes.
    keys = ["user", "lb", "rb"]
    return spread(left, *keys).join(spread(right, *keys), keys).select(
        "user", "command", "freq", edit_similarity("command", "past").alias("similarity")
    )


def weighted_similarity(pairs: DataFrame) -> DataFrame:
    """Frequency-weighted mean similarity per user and command."""
    return pairs.groupBy("user", "command").agg(
        ratio_or_zero(F.sum(F.col("similarity") * F.col("freq")), F.sum("freq").cast("double"))
        .alias("weighted_avg_similarity")
    )


def zscore_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Population z-score of ``value`` within ``key``: 0 for a single row, null without variation.

    Counts, means and spreads are combined before they are shuffled, so the rows
    of a key are never gathered.
    """
    v = F.col(value)
    stats = df.groupBy(key).agg(
        F.count("*").alias("z_n"), F.avg(v).alias("z_mean"), F.stddev_pop(v).alias("z_spread")
    )
    noise = F.lit(SPREAD_TOLERANCE) * F.greatest(F.abs("z_mean"), F.lit(1.0))
    score = F.when(F.col("z_n") == 1, F.lit(0.0)).when(
        F.col("z_spread") > noise, (v - F.col("z_mean")) / F.col("z_spread")
    )
    return df.join(stats, key).withColumn("z_score", score).drop("z_n", "z_mean", "z_spread")


def similarity_anomalies(
    commands: DataFrame, history: DataFrame, z_threshold: float = Z_THRESHOLD, block_size: int = BLOCK_SIZE,
    z_digits: int = Z_DIGITS,
) -> DataFrame:
    """Score every command row of every user: similarity to history, z-score, flag.

    ``commands`` has user and cleaned_command, ``history`` user, command, freq.
    A command already in the history is 1.0 and needs no comparison. Each
    distinct command is scored once, then attached to its rows. Z-scores are
    rounded to ``z_digits`` before they meet the threshold, so that the order of
    a sum decides no flag.
    """
    history = history.groupBy("user", "command").agg(F.sum("freq").alias("freq"))
    wanted = commands.select("user", F.col("cleaned_command").alias("command")).distinct()
    known = history.select("user", "command", F.lit(1.0).alias("known"))
    marked = wanted.join(known, ["user", "command"], "left")
    unseen = marked.where(F.col("known").isNull()).select("user", "command")
    compared = weighted_similarity(similarity_pairs(unseen, history, block_size))
    # The comparisons are the costly part and are read twice below.
    scored = materialise(marked.join(compared, ["user", "command"], "left").select(
        "user", F.col("command").alias("cleaned_command"),
        F.coalesce("known", "weighted_avg_similarity", F.lit(0.0)).alias("weighted_avg_similarity"),
    ), "command-scores")
    z = zscore_by(commands.join(scored, ["user", "cleaned_command"]), "user", "weighted_avg_similarity")
    return z.withColumn("anomaly", F.coalesce(F.round("z_score", z_digits) < z_threshold, F.lit(False)))
