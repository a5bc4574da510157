"""Session helpers: the shared scratch folder and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without the setting (tests) gets a temporary folder; a
    cluster session without it is an error, since a machine-local folder
    would be lost with its executor.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    root = tempfile.mkdtemp(prefix="tidewatch-")
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so several jobs over the result do not repeat the work
    before it, and lost executors re-read files instead of recomputing. The
    folder is the caller's to clean, like Spark's own checkpoints.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Partition ``df`` by ``columns`` into ``spark.sql.shuffle.partitions`` tasks.

    Adaptive execution merges partitions of few bytes. Where a task's work is
    far larger than its input, that would leave it all to one task; a stated
    number of partitions is not merged.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
