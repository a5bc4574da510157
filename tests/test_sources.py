import datetime as dt

import pytest

from tests.conftest import rows
from tidewatch.session import materialise, scratch_root
from tidewatch.sources import list_tables_catalog, load_ids, load_unified, read_table, save_unified
from tidewatch.sources.jdbc import read_options

D = dt.date
UNIFIED = "user string, metric_name string, metric_value double, index_value int, week_start_date date, date date, n_weeks int"


def test_unified_dates_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "u")

    def day(d, value):
        return spark.createDataFrame([("a", "total calls volume", value, 1, D(2024, 1, 1), D(2024, 1, d), None)], UNIFIED)

    save_unified(day(1, 1.0).union(day(2, 2.0)), path)
    save_unified(day(2, 5.0), path)
    assert rows(load_unified(spark, path), "date", "metric_value") == [(D(2024, 1, 1), 1.0), (D(2024, 1, 2), 5.0)]
    scan = load_unified(spark, path, "daily")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric_family" in scan


def test_ids(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "directory_id string, x int").write.parquet(str(tmp_path / "ids"))
    assert rows(load_ids(spark, str(tmp_path / "ids"))) == [("a",)]


def test_read_table_of_any_format(spark, tmp_path):
    for fmt in ("parquet", "orc", "json"):
        path = str(tmp_path / fmt)
        spark.range(3).write.format(fmt).save(path)
        assert read_table(spark, fmt, path).count() == 3


def test_jdbc_options():
    one = read_options("jdbc:x:y", "t")
    assert one["dbtable"] == "t" and "partitionColumn" not in one
    many = read_options("jdbc:x:y", "t", "id", (1, 100), 8)
    assert (many["partitionColumn"], many["lowerBound"], many["upperBound"], many["numPartitions"]) == ("id", "1", "100", "8")
    with pytest.raises(ValueError):
        read_options("jdbc:x:y", "t", "id")


def test_catalog_tables(spark):
    spark.range(1).createOrReplaceTempView("a_temp_view")
    assert "a_temp_view" not in list_tables_catalog(spark)


def test_materialise_uses_the_shared_folder(spark):
    df = materialise(spark.range(4), "t")
    assert df.count() == 4
    assert all(scratch_root(spark) in f for f in df.inputFiles())
