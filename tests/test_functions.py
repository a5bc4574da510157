import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import functions as fn
from tidewatch.functions.scores import entropy_bits, normalised_entropy
from tidewatch.schemas import require_columns


def one(spark, values, expr, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema).withColumn("i", F.monotonically_increasing_id())
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_hour_of_week_runs_from_monday(spark):
    days = [dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 7, 23), dt.datetime(2024, 1, 3, 5)]
    assert one(spark, days, fn.hour_of_week("x"), "x timestamp_ntz") == [1, 168, 54]
    assert one(spark, days, fn.hour_of_week("x", base=0), "x timestamp_ntz") == [0, 167, 53]


def test_week_start_anchors(spark):
    days = [dt.date(2025, 9, d) for d in (21, 22, 23, 24)]
    assert one(spark, days, fn.week_start("x"), "x date") == [
        dt.date(2025, 9, 15), dt.date(2025, 9, 22), dt.date(2025, 9, 22), dt.date(2025, 9, 22)]
    assert one(spark, days, fn.week_start("x", "tuesday"), "x date") == [
        dt.date(2025, 9, 16), dt.date(2025, 9, 16), dt.date(2025, 9, 23), dt.date(2025, 9, 23)]
    with pytest.raises(ValueError):
        fn.week_start("x", "friday")


def test_parse_ts_reads_the_usual_forms(spark):
    at = dt.datetime(2024, 8, 1, 13, 5)
    texts = ["2024-08-01 13:05", "8/1/2024 13:05", "8/1/2024 1:05 PM", "08/01/2024 01:05:00 PM", "20240801130500", "2024/8/1 13:05", "1 Aug 2024 13:05", "Aug 1, 2024 1:05 PM"]
    assert one(spark, texts, fn.parse_ts("x")) == [at] * len(texts)
    assert one(spark, ["8/1/2024", "20240801", "13/1/2024", "soon"], fn.parse_ts("x")) == [dt.datetime(2024, 8, 1)] * 2 + [None] * 2


def test_unreadable_times_are_counted(spark):
    df = spark.createDataFrame([("soon",), ("soon",), ("8/1/2024",), (None,)], "x string")
    assert [tuple(r) for r in fn.unreadable_times(df, "x").collect()] == [("soon", 2)]


def test_parse_ts_is_lenient(spark):
    got = one(spark, ["2024-01-05 01:02:03.5", "bad", None, "2024-01-05"], fn.parse_ts("x"))
    assert got == [dt.datetime(2024, 1, 5, 1, 2, 3, 500000), None, None, dt.datetime(2024, 1, 5)]
    assert one(spark, ["05/01/2024 10:00"], fn.parse_ts("x", "dd/MM/yyyy HH:mm")) == [dt.datetime(2024, 1, 5, 10)]


def test_strip_takes_tabs_and_newlines(spark):
    assert one(spark, ["\t a b \n", "  "], fn.strip("x")) == ["a b", ""]


@pytest.mark.parametrize("raw, group", [
    (None, "UNKNOWN_CMD"), ("  \t", "UNKNOWN_CMD"), ("show run", "SHOW_CONFIG"), ("SHOW Running-config", "SHOW_CONFIG"),
    ("conf t", "CONFIG_MODE"), ("conf terminal", "CONFIG_MODE"), ("configure terminal", "CONFIG_MODE"),
    ("configure", "CONFIGURE"), ("conf", "CONF"), ("reload in 5", "RELOAD"), ("reboot", "RELOAD"),
    ("copy run start", "COPY"), ("copy", "COPY"), ("username x", "USER_MGMT"), ("delete user bob", "USER_MGMT"),
    ("show user", "SHOW"), ("\tping\t8.8.8.8", "PING"), ("add users", "USER_MGMT"),
])
def test_normalize_command(spark, raw, group):
    assert one(spark, [raw], fn.normalize_command("x")) == [group]


@pytest.mark.parametrize("name, expected", [
    (None, False), (" ", False), ("listed", False), ("svc-app", True), ("abc", True), ("abcdefghij", True),
    ("a.bcd", True), ("JohnD", True), ("Vjohn", False), ("vjohN", False), ("ABCDE", False), ("johnd", False),
    ("adminx", True), ("  abcd  ", False),
])
def test_likely_functional(spark, name, expected):
    assert one(spark, [name], fn.likely_functional("x", F.col("x") == "listed")) == [expected]


def test_parse_allowlist(spark):
    got = one(spark, ["a, b", " ", None, "a,,b"], fn.parse_allowlist("x", True))
    assert got == [["a", "b"], None, None, ["a", "", "b"]]
    assert one(spark, [["1"], [], None], fn.parse_allowlist("x", False), "x array<string>") == [["1"], [], None]


def test_edit_similarity(spark):
    df = spark.createDataFrame([("", ""), ("abc", "abc"), ("kitten", "sitting"), ("", "ab")], "a string, b string")
    got = [r[0] for r in df.select(fn.edit_similarity("a", "b")).collect()]
    assert got == [1.0, 1.0, 1 - 3 / 7, 0.0]


def test_three_digits_rounds_like_python(spark):
    rng = random.Random(1)
    values = [k / n for n in (16, 40, 80, 400, 2000, 16000) for k in range(0, n, max(1, n // 97))]
    values += [0.0005, 0.0015, 0.0375, 0.0125, 2.6755, 1.0005, 12345.0625] + [rng.random() * 50 for _ in range(500)]
    assert one(spark, values, fn.three_digits("x"), "x double") == [f"{v:.3f}" for v in values]


def test_is_manual(spark):
    got = one(spark, ["Manual call", "manually", None, "a manual"], fn.is_manual("x"))
    assert got == [True, False, False, True]


def test_entropy(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5), ("c", 0), ("d", 2), ("d", 2), ("d", 0)], "k string, w int")
    got = {r.k: (r.h, r.n) for r in df.groupBy("k").agg(entropy_bits("w").alias("h"), normalised_entropy("w").alias("n")).collect()}
    assert got["a"] == pytest.approx((0.8112781, 0.8112781))
    assert got["b"] == (0.0, 0.0) and got["c"] == (0.0, 0.0)
    assert got["d"] == pytest.approx((1.0, 1.0))


def test_drawing_sizes_and_misc(spark):
    assert one(spark, [2, 10], fn.node_size("x"), "x int") == [80.0, 120.0]
    assert one(spark, [0, 16], fn.edge_width("x"), "x int") == pytest.approx([0.5, 16 ** 0.8])
    assert one(spark, [0.4, 3.0], fn.cap_at_one("x"), "x double") == [0.4, 1.0]
    assert one(spark, [0, 25, 167], fn.grid_day("x"), "x int") == [0, 1, 6]
    assert one(spark, [0, 25, 167], fn.grid_hour("x"), "x int") == [0, 1, 23]
    assert one(spark, ["a  b\tc", " ", None], fn.tokens("x")) == [["a", "b", "c"], [], []]


def test_require_columns(spark):
    df = spark.range(1)
    assert require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="missing_one"):
        require_columns(df, ["id", "missing_one"])
