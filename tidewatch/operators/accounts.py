"""Account curation: machine or person, from the directory and the account name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import likely_functional, strip


def in_directory(df: DataFrame, ids: DataFrame, column: str = "user", id_column: str = "directory_id") -> DataFrame:
    """Add ``in_directory``: whether the name, in any case, is a directory id (``id_column`` of ``ids``).

    Ids are made distinct after lowering, so no row is multiplied.
    """
    known = ids.select(F.lower(id_column).alias("directory_id")).where(F.col("directory_id").isNotNull()).distinct()
    name = F.lower(strip(column))
    return (
        df.join(known, name == F.col("directory_id"), "left")
        .withColumn("in_directory", F.col("directory_id").isNotNull()).drop("directory_id")
    )


def curate_accounts(df: DataFrame, ids: DataFrame, id_column: str = "directory_id") -> DataFrame:
    """Add ``is_functional`` and ``user_type`` for the account name in ``user``."""
    return (
        in_directory(df, ids, id_column=id_column)
        .withColumn("is_functional", likely_functional("user", F.col("in_directory")))
        .withColumn("user_type", F.when(F.col("is_functional"), "functional_user").otherwise("human_user"))
        .drop("in_directory")
    )


def to_pipeline_type(c: Column | str) -> Column:
    """Curated label to the type name the access pipelines use."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "functional_user", "functional").when(c == "human_user", "human").otherwise(c)
