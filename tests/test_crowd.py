import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from hourspark.operators.quality import ContractError, assert_schema
from hourspark.plans import crowd
from hourspark.schemas import CROWD_DDL, HISTORICAL_COLUMNS, MODERN_COLUMNS, struct_of

OLD = ", ".join(f"{c} string" for c in HISTORICAL_COLUMNS) + ", row_number long"
NEW = ", ".join(f"{c} {'binary' if c == 'location' else 'string'}" for c in MODERN_COLUMNS) + ", row_number long"
TEXT = NEW.replace("binary", "string")


def old(spark, *data):
    return spark.createDataFrame([(i, "x", y, m, d, "x", h, s, n, c, k) for k, (i, y, m, d, h, s, n, c) in enumerate(data, 1)], OLD)


def new(spark, schema, *data):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(data, 1)], schema)


def build(spark, historical=(), archived=(), current=()):
    sensors = spark.createDataFrame([(1,), (4,)], "location_id int")
    none = spark.createDataFrame([], "ID string, recovered_hour int")
    return crowd.canonical([
        crowd.historical(old(spark, *historical), none), crowd.modern(new(spark, TEXT, *archived), crowd.ARCHIVED_ID),
        crowd.modern(new(spark, NEW, *current), crowd.CURRENT_ID),
    ], sensors)


POINT = bytearray(struct.pack("<BIdd", 1, 1, 144.96, -37.81))


def test_source_windows_do_not_overlap(spark):
    hist = [("1", "2022", "October", "31", "5", "1", "A", "10"), ("2", "2022", "November", "1", "5", "1", "A", "11")]
    modern = [(str(i), "1", d, "6", "3", "4", "7", " B ", None) for i, d in enumerate(["2022-10-31", "2022-11-01", "2024-08-20", "2024-08-21"])]
    table = build(spark, hist, modern, [(*m[:8], POINT) for m in modern])
    got = {(r.source_dataset_id, r.local_date) for r in table.collect()}
    assert got == {
        (crowd.HISTORICAL_ID, dt.date(2022, 10, 31)), (crowd.ARCHIVED_ID, dt.date(2022, 11, 1)),
        (crowd.ARCHIVED_ID, dt.date(2024, 8, 20)), (crowd.CURRENT_ID, dt.date(2024, 8, 21)),
    }
    assert_schema(table, struct_of(CROWD_DDL))


def test_fields_of_a_row(spark):
    row = build(spark, current=[("r", "4", "2025-01-15", "7", None, "2", "9", "  ", POINT)]).first()
    assert (row.observation_key, row.observed_at_local) == ("4:20250115:07", dt.datetime(2025, 1, 15, 7))
    assert (row.direction_1_count, row.direction_2_count, row.direction_counts_valid) == (None, 2, False)
    assert (row.sensor_name, row.sensor_name_missing, row.sensor_in_current_metadata) == (None, True, True)
    assert (row.latitude, row.longitude, row.coordinate_valid, row.is_dst, row.day_of_week) == (-37.81, 144.96, True, True, 2)


def test_repeated_key_fails(spark):
    twice = [("1", "2015", "May", "3", "5", "1", "A", "10"), ("2", "2015", "May", "3", "5", "1", "A", "10")]
    with pytest.raises(ContractError, match="duplicate_key_groups"):
        crowd.validated(build(spark, twice))


def malformed(spark, days=30, spoil=False):
    n = days * 24 * 17
    df = spark.range(n).select(
        F.col("id").cast("string").alias("ID"), F.lit("x").alias("Date_Time"), F.lit("2010").alias("Year"), F.lit("September").alias("Month"),
        (F.floor(F.col("id") / 408) + 1).cast("string").alias("Mdate"), F.lit("x").alias("Day"), F.lit("0").alias("Time"),
        (F.pmod("id", F.lit(17)) + 1).cast("string").alias("Sensor_ID"), F.lit("S").alias("Sensor_Name"), F.lit("5").alias("Hourly_Counts"),
        (F.col("id") + 1).alias("row_number"),
    )
    return df.withColumn("Sensor_ID", F.when(F.col("ID").isin("40", "41"), F.lit("1")).otherwise(F.col("Sensor_ID"))) if spoil else df


def test_hour_zero_block_is_repaired(spark):
    table = crowd.canonical([crowd.historical(malformed(spark))], spark.createDataFrame([(1,)], "location_id int"))
    facts = table.agg(F.count("*"), F.count_if("hour_was_reconstructed"), F.min("local_hour"), F.max("local_hour"), F.count_distinct("observation_key")).first()
    assert tuple(facts) == (12240, 12240, 0, 23, 12240)


def test_block_of_another_shape_fails(spark):
    with pytest.raises(ContractError, match="known shape"):
        crowd.find_repairs(malformed(spark, spoil=True))
    with pytest.raises(ContractError, match="known shape"):
        crowd.find_repairs(malformed(spark, days=29))


def test_sound_month_needs_no_repair(spark):
    sound = old(spark, ("1", "2010", "September", "1", "0", "1", "A", "1"), ("2", "2010", "September", "1", "0", "2", "A", "1"))
    assert crowd.find_repairs(sound).count() == 0
