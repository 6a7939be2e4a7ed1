import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from hourspark.functions import geo, labels, numbers, text, timestamps as ts
from hourspark.functions.holidays import holiday_calendar


def wall(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t string").select(F.col("t").cast("timestamp_ntz").alias("w"))


def test_wall_status_on_change_days(spark):
    df = wall(spark, "2023-04-02 02:30:00", "2023-10-01 02:30:00", "2023-01-15 12:00:00", "2023-07-15 12:00:00")
    got = [tuple(r.s) for r in df.select(ts.wall_status(F.col("w")).alias("s")).collect()]
    assert got == [(None, True, False), (None, False, True), (True, False, False), (False, False, False)]


def test_wall_to_utc_takes_standard_time_in_the_repeated_hour(spark):
    df = wall(spark, "2023-04-02 02:30:00", "2023-10-01 02:30:00", "2026-06-01 13:05:00")
    got = [r[0] for r in df.select(ts.wall_to_utc(F.col("w"))).collect()]
    assert got == [dt.datetime(2023, 4, 1, 16, 30), None, dt.datetime(2026, 6, 1, 3, 5)]


def test_wall_text_needs_the_z(spark):
    df = spark.createDataFrame([("2026-06-01T13:05:00Z",), ("2026-06-01T13:05:00",), ("xZ",)], "t string")
    assert [r[0] for r in df.select(ts.wall_text(F.col("t"))).collect()] == [dt.datetime(2026, 6, 1, 13, 5), None, None]


def test_fallback_wrap_only_inside_the_repeated_hour(spark):
    df = wall(spark, "2023-04-02 02:55:00", "2023-05-02 02:55:00").withColumn("e", F.date_trunc("hour", "w").cast("timestamp_ntz"))
    assert [r[0] for r in df.select(ts.fallback_wrap(F.col("w"), F.col("e"))).collect()] == [True, False]


def test_half_even_is_the_exact_binary_rule(spark):
    values = [k / 20000 for k in range(0, 20000, 7)] + [i + 0.5 for i in range(-9, 9)] + [2.675, 1.005, -0.46295]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 4):
        got = df.select("x", numbers.half_even(F.col("x"), digits).alias("y")).collect()
        assert all(r.y == round(r.x, digits) for r in got)


def test_identifiers_and_booleans(spark):
    df = spark.createDataFrame([("44864.0",), (" 7 ",), ("nan",), ("",), (None,), ("Yes",), ("maybe",)], "t string")
    assert [r[0] for r in df.select(text.canonical_id(F.col("t"))).collect()] == ["44864", "7", None, None, None, "Yes", "maybe"]
    assert [r[0] for r in df.select(text.bool_text(F.col("t"))).collect()][-2:] == [True, None]
    assert [r[0] for r in df.select(text.bool_text_fault(F.col("t"))).collect()][-2:] == [False, True]


def test_unknown_month_fails(spark):
    df = spark.createDataFrame([("2010", "Sept", "1")], "y string, m string, d string")
    with pytest.raises(Exception, match="unknown month"):
        df.select(text.date_from_parts(F.col("y"), F.col("m"), F.col("d"))).collect()


def test_wkb_points(spark):
    good = struct.pack("<BIdd", 1, 1, 144.96, -37.81)
    big = struct.pack(">BIdd", 0, 1, 144.96, -37.81)
    line = struct.pack("<BIdd", 1, 2, 144.96, -37.81)
    df = spark.createDataFrame([(bytearray(good),), (bytearray(big),), (bytearray(line),), (bytearray(good[:9]),), (None,)], "b binary")
    got = [tuple(r.p) for r in df.select(geo.wkb_point("b").alias("p")).collect()]
    assert got == [(-37.81, 144.96), (-37.81, 144.96), (None, None), (None, None), (None, None)]


def test_overlapping_mode_patterns_take_the_strongest(spark):
    df = spark.createDataFrame([("commuter",), ("eScooter",), ("Person",), (None,)], "c string")
    assert [r[0] for r in df.select(labels.mode_of(F.col("c"))).collect()] == ["vehicle", "cyclist", "pedestrian", "other"]


def test_angle_difference_stays_in_half_open_range(spark):
    df = spark.createDataFrame([(350.0, 10.0), (10.0, 350.0), (0.0, 180.0), (180.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(geo.angle_difference(F.col("a"), F.col("b"))).collect()] == [20.0, -20.0, 180.0, 180.0]


def test_quality_flags_are_sorted_and_null_is_false(spark):
    df = spark.sql("SELECT true AS p, CAST(NULL AS boolean) AS a, true AS d")
    flags = text.flag_string({"partial": F.col("p"), "alarm": F.col("a"), "derived_zero": F.col("d")})
    assert df.select(flags).first()[0] == "derived_zero;partial"


def test_holidays_and_overrides(spark, rows):
    bounds = spark.sql("SELECT DATE '2024-01-01' AS lo, DATE '2024-12-31' AS hi")
    extra = spark.sql("SELECT DATE '2024-09-27' AS local_date, 'Friday before the Grand Final' AS public_holiday_name")
    days = holiday_calendar(bounds, "lo", "hi", extra).filter("is_public_holiday")
    got = {r.local_date.strftime("%m-%d") for r in days.collect()}
    assert got == {"01-01", "01-26", "03-11", "03-29", "03-30", "03-31", "04-01", "04-25", "06-10", "09-27", "11-05", "12-25", "12-26"}
