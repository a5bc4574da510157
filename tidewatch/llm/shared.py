"""Helpers of the operators: stored tables, words, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialise

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column | str) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_table_sql() -> str:
    """DuckDB CTEs (of a WITH RECURSIVE) that end in ``crc_table``, one row with the table of CRC-32."""
    return """crc_steps(i, x, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(x ORDER BY i) AS crc_list FROM crc_steps WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of the UTF-8 bytes of ``text``, beside the one row of ``crc_table``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    return (f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, crc_list[(xor(c, b) & 255) + 1]), "
            "CAST(4294967295 AS BIGINT)))")


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def components(links: DataFrame, name: str) -> DataFrame:
    """``node``, ``root``: the connected components of the links ``a``, ``b``.

    The root is the smallest node of the component. Each round every node
    takes the first label among its own and its neighbours', and the links are
    rewritten to the labels, until none is left. Two rounds order the labels by
    value (which contracts a star wholly), the third by hash (which contracts
    a chain by a constant factor), and so on. All joins are between stored tables,
    so adaptive execution can split a label held by most rows. Nodes without
    links are not returned; null nodes are not allowed.
    """
    edges = materialise(links.select("a", "b").where("a <> b").distinct(), f"{name}-links")
    labels = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if turn % 3 == 2:
            key = F.struct(F.xxhash64("b", F.lit(turn)), "b")
            own = F.struct(F.xxhash64("a", F.lit(turn)), F.col("a").alias("b"))
        else:
            key, own = F.struct(F.lit(0).cast("long"), "b"), F.struct(F.lit(0).cast("long"), F.col("a").alias("b"))
        step = both.groupBy("a").agg(F.min(key).alias("near")).select(
            F.col("a").alias("node"), F.least("near", own)["b"].alias("next"))
        step = materialise(step, f"{name}-step")
        if labels is None:
            labels = step.select("node", F.col("next").alias("root"))
        else:
            labels = labels.join(step.withColumnRenamed("node", "root"), "root", "left").select(
                "node", F.coalesce("next", "root").alias("root"))
        labels = materialise(labels, f"{name}-labels")
        for end in ("a", "b"):
            edges = edges.join(step.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("next", end)
        edges = materialise(edges.select("a", "b").where("a <> b").distinct(), f"{name}-links")
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = materialise(labels.groupBy("root").agg(F.min("node").alias("least")), f"{name}-least")
    return materialise(labels.join(least, "root").select("node", F.col("least").alias("root")), f"{name}-roots")
