"""File tables: call CSVs, unified metrics, report, directory ids, baseline, models."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse_ts, strip
from ..ml.forest import IsolationForestModel
from ..operators.calls import STATE, metric_family
from ..schemas import ACCESS_BASELINE, REPORT_COLUMNS, UNIFIED, UNIFIED_COLUMNS, require_columns

CALL_COLUMNS = ["user", "account", "id_chat", "dttm"]
# Texts that stand for a missing value in call logs.
MISSING_MARKS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _read_or_empty(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """Read a parquet table, or an empty one when the path does not exist."""
    try:
        return spark.read.schema(schema).options(**options).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


POINTER = "name STRING, as_of DATE, week_anchor STRING"
SHARES = "date DATE, user STRING, totals ARRAY<BIGINT>, manuals ARRAY<BIGINT>, source_file STRING"


def _text(column: str) -> Column:
    return F.when(~F.col(column).isin(MISSING_MARKS), F.col(column))


def _read_calls(spark: SparkSession, path: str, formats: tuple[str, ...] = (), **options: str) -> DataFrame:
    # Headers are checked against each other, and doubled quotes stand for one.
    raw = spark.read.options(header=True, enforceSchema=False, escape='"', **options).csv(path)
    require_columns(raw, CALL_COLUMNS, "call log")
    if raw.isEmpty():
        raise ValueError(f"{path} has no rows")
    return raw.select(
        strip(_text("user")).alias("user"), _text("account").alias("account"),
        strip(_text("id_chat")).alias("id_chat"),
        parse_ts("dttm", *formats).alias("dttm"), F.col("_metadata.file_path").alias("source_file"),
    ).dropna(subset=["dttm", "user"])


def read_calls_csv(spark: SparkSession, path: str, formats: tuple[str, ...] = (), **options: str) -> DataFrame:
    """One day's call log; rows without a readable time or a user are dropped.

    ``formats`` are the forms of its times if they are not the usual ones;
    ``unreadable_times`` counts texts that do not parse.
    ``options`` are CSV options; ``multiLine`` is needed for notes with line
    breaks and keeps each file in one task.
    """
    return _read_calls(spark, path, formats, **options)


def read_calls_folder(
    spark: SparkSession, folder: str, glob: str = "*.csv", formats: tuple[str, ...] = (), **options: str
) -> DataFrame:
    """Call logs of a folder in one read; ``source_file`` tells them apart."""
    return _read_calls(spark, folder, formats, pathGlobFilter=glob, **options)


def file_order(calls: DataFrame) -> DataFrame:
    """Source files by the day they end on, then by name."""
    days = calls.groupBy("source_file").agg(F.to_date(F.max("dttm")).alias("date"))
    return days.orderBy(F.asc_nulls_first("date"), "source_file")


def load_unified(spark: SparkSession, path: str, family: str | None = None) -> DataFrame:
    """Unified metrics, or one family of them (read from its own folder)."""
    schema = f"{UNIFIED}, metric_family STRING"
    table = _read_or_empty(spark, path, schema)
    if family:
        table = table.where(F.col("metric_family") == family)
    return table.select(*UNIFIED_COLUMNS)


def save_unified(df: DataFrame, path: str, dealt: bool = False) -> None:
    """Write metric rows by family and date, replacing just the dates written.

    Baseline rows have no date; the baseline family is a snapshot and is
    replaced whole by ``save_baseline_snapshot``. Rows that are ``dealt`` by
    date already, in partitions of bounded size, are not shuffled again.
    """
    rows = df.withColumn("metric_family", metric_family("metric_name"))
    if not dealt:
        # Large days are split and small ones merged by their bytes.
        rows = rows.hint("rebalance", F.col("metric_family"), F.col("date"))
    (
        rows.sortWithinPartitions("metric_family", "date", "user", "metric_name", "index_value")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("metric_family", "date").parquet(path)
    )


def load_shares(spark: SparkSession, path: str) -> DataFrame:
    """What each file added to its day: date, user, counters, source_file."""
    return _read_or_empty(spark, f"{path}/_shares", SHARES)


def save_shares(shares: DataFrame, path: str) -> None:
    """Store the counters of files beside the unified table, replacing those of the same files."""
    (
        shares.repartition("source_file").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(f"{path}/_shares")
    )


def load_state(spark: SparkSession, path: str, week_anchor: str) -> tuple[date, DataFrame] | None:
    """The week before which the stored running state adds up, and the state; none if nothing fits."""
    pointer = _read_or_empty(spark, f"{path}/_state/current", POINTER).first()
    if pointer is None or pointer["week_anchor"] != week_anchor:
        return None
    return pointer["as_of"], _read_or_empty(spark, f"{path}/_state/{pointer['name']}", STATE)


def save_state(state: DataFrame, path: str, as_of: date, week_anchor: str) -> None:
    """Store a running state apart from the one before, then point to it.

    A job that ends between the two leaves the old pointer, or none, in which case
    the state is added up from the daily rows again.
    """
    name = f"as_of={as_of}-{uuid.uuid4().hex}"
    state.write.parquet(f"{path}/_state/{name}")
    pointer = state.sparkSession.createDataFrame([(name, as_of, week_anchor)], POINTER)
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{path}/_state/current")


def save_baseline_snapshot(df: DataFrame, path: str) -> None:
    """Replace the stored averages; an empty snapshot leaves none."""
    (
        df.drop("metric_family").sortWithinPartitions("user", "metric_name", "index_value")
        .write.mode("overwrite").option("partitionOverwriteMode", "static")
        .partitionBy("date").parquet(f"{path}/metric_family=baseline")
    )


def read_table(spark: SparkSession, fmt: str, path: str | None = None, **options: str) -> DataFrame:
    """A whole table of any format the session has a connector for."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load(path) if path else reader.load()


def load_ids(spark: SparkSession, path: str, column: str = "directory_id") -> DataFrame:
    """Distinct directory ids, left distributed; ``column`` holds them in the file."""
    return spark.read.parquet(path).select(F.col(column).alias("directory_id")).dropna().distinct()


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return _read_or_empty(spark, path, ACCESS_BASELINE)


def save_baseline(added: DataFrame, path: str) -> None:
    """Append newly known keys under their ``as_of`` date; nothing is rewritten.

    Saving a date again replaces that date only.
    """
    added.hint("rebalance", F.col("as_of")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("as_of").parquet(path)


def save_models(spark: SparkSession, human: IsolationForestModel, functional: IsolationForestModel, path: str) -> None:
    human.save(spark, f"{path}/human")
    functional.save(spark, f"{path}/functional")


def load_models(spark: SparkSession, path: str) -> tuple[IsolationForestModel, IsolationForestModel]:
    return IsolationForestModel.load(spark, f"{path}/human"), IsolationForestModel.load(spark, f"{path}/functional")


def load_report(source: DataFrame, columns: list[str] = REPORT_COLUMNS, formats: tuple[str, ...] = ()) -> DataFrame:
    """Check and type a report or call-log table read by any source."""
    require_columns(source, columns, "report")
    typed = source.select(*columns).withColumn("dttm", parse_ts("dttm", *formats))
    return typed.withColumn("date", F.col("date").try_cast("date")) if "date" in columns else typed
