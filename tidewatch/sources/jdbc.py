"""Database tables over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas a database keeps for itself.
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema"]
FETCH_ROWS = 10_000


def read_options(
    url: str, table: str, partition_column: str | None = None, bounds: tuple[str, str] | None = None,
    partitions: int | None = None, **options: str,
) -> dict[str, str]:
    """Reader options; with a partition column the table is read in parallel ranges."""
    out = {"url": url, "dbtable": table, "fetchsize": str(FETCH_ROWS), **options}
    if partition_column:
        if bounds is None or partitions is None:
            raise ValueError("a partition column needs bounds and a number of partitions")
        out |= {
            "partitionColumn": partition_column, "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]), "numPartitions": str(partitions),
        }
    return out


def read_jdbc(
    spark: SparkSession, url: str, table: str, limit: int | None = None, **options
) -> DataFrame:
    """A database table; filters, columns and the limit are sent to the database."""
    df = spark.read.format("jdbc").options(**read_options(url, table, **options)).load()
    return df.limit(limit) if limit is not None else df


def write_jdbc(df: DataFrame, url: str, table: str, batch_rows: int = FETCH_ROWS, **options: str) -> None:
    """Append rows in batches. Each task commits on its own, so a failed job can leave
    part of its rows behind."""
    df.write.format("jdbc").mode("append").options(
        url=url, dbtable=table, batchsize=str(batch_rows), **options
    ).save()


def list_tables_jdbc(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """Base tables of a database outside its system schemas."""
    tables = read_jdbc(spark, url, "information_schema.tables", **options)
    return tables.where(
        (F.col("table_type") == "BASE TABLE") & ~F.col("table_schema").isin(SYSTEM_SCHEMAS)
    ).select("table_schema", "table_name")


def list_tables_catalog(spark: SparkSession, database: str | None = None) -> list[str]:
    """Permanent tables of the session catalog."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
