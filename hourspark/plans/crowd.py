"""Canonical hourly pedestrian counts from three overlapping publisher snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.functions.geo import wkb_point
from hourspark.functions.text import date_from_parts, hour_key, text_point
from hourspark.functions.timestamps import MELBOURNE, at_hour, calendar_columns, wall_status
from hourspark.operators.intervals import repaired_hours
from hourspark.operators.quality import Expectation, conform, enforce, require_columns
from hourspark.schemas import CROWD_DDL, CROWD_KEY, HISTORICAL_COLUMNS, MODERN_COLUMNS, struct_of

# Source ids and the windows in which each source counts.
HISTORICAL_ID = "com_pedestrian_counts_2009_2022"
ARCHIVED_ID = "com_pedestrian_counts_wayback_20250112"
CURRENT_ID = "com_pedestrian_counts_current"
HISTORICAL_LAST = dt.date(2022, 10, 31)
ARCHIVED_FIRST, ARCHIVED_LAST = dt.date(2022, 11, 1), dt.date(2024, 8, 20)
CURRENT_FIRST = dt.date(2024, 8, 21)


def source_window(day: Column, first: dt.date | None, last: dt.date | None) -> Column:
    """Rows of a source that count; the windows of the sources do not overlap."""
    keep = F.lit(True)
    if first:
        keep = keep & (day >= F.lit(first))
    if last:
        keep = keep & (day <= F.lit(last))
    return keep


def directions_valid(first: Column, second: Column, total: Column) -> Column:
    """Both directions present, not negative and adding up to the total."""
    return F.coalesce((first >= 0) & (second >= 0) & (first + second == total), F.lit(False))


def historical(rows: DataFrame, repaired: DataFrame | None = None) -> DataFrame:
    """Common shape of the oldest snapshot; ``rows`` carries row_number from the landing job.

    ``repaired`` maps a record to its recovered hour.
    """
    require_columns(rows, [*HISTORICAL_COLUMNS, "row_number"], "historical snapshot")
    if repaired is None:
        repaired = find_repairs(rows)
    hours = repaired.select(F.col("ID").alias("_id"), "recovered_hour")
    dated = rows.withColumn("local_date", date_from_parts(F.col("Year"), F.col("Month"), F.col("Mdate")))
    return dated.filter(source_window(F.col("local_date"), None, HISTORICAL_LAST)).join(
        hours, F.col("ID") == F.col("_id"), "left"
    ).select(
        F.lit(HISTORICAL_ID).alias("source_dataset_id"), F.col("ID").alias("source_record_id"),
        F.col("row_number").alias("source_row_number"), F.col("Sensor_ID").cast("int").alias("sensor_id"),
        F.col("Sensor_Name").alias("sensor_name"), "local_date",
        F.coalesce("recovered_hour", F.col("Time").cast("int")).alias("local_hour"),
        F.col("Hourly_Counts").cast("bigint").alias("pedestrian_flow"),
        F.lit(None).cast("bigint").alias("direction_1_count"), F.lit(None).cast("bigint").alias("direction_2_count"),
        F.lit(None).cast("boolean").alias("direction_counts_valid"), F.lit("total_only").alias("direction_semantics"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        F.col("recovered_hour").isNotNull().alias("hour_was_reconstructed"),
    )


def find_repairs(rows: DataFrame) -> DataFrame:
    """Recovered hours of the known malformed month, empty when the month is sound."""
    block = rows.filter((F.col("Year").try_cast("int") == 2010) & (F.trim("Month") == "September")).select(
        "ID", F.col("Mdate").cast("int").alias("Mdate"), F.col("Time").cast("int").alias("Time"),
        F.col("Sensor_ID").cast("int").alias("Sensor_ID"), "row_number",
    )
    return repaired_hours(block, "Mdate", "Sensor_ID", "row_number", "Time", "ID")


def modern(rows: DataFrame, source_id: str) -> DataFrame:
    """Common shape of the archived (text points) and the current (binary points) snapshot."""
    require_columns(rows, [*MODERN_COLUMNS, "row_number"], source_id)
    day = F.col("sensing_date").cast("date")
    archived = source_id == ARCHIVED_ID
    window = (ARCHIVED_FIRST, ARCHIVED_LAST) if archived else (CURRENT_FIRST, None)
    one, two = F.col("direction_1").try_cast("bigint"), F.col("direction_2").try_cast("bigint")
    total = F.col("pedestriancount").cast("bigint")
    kept = rows.filter(source_window(day, *window)).withColumn(
        "_p", text_point(F.col("location")) if archived else wkb_point("location")
    )
    return kept.select(
        F.lit(source_id).alias("source_dataset_id"), F.col("id").cast("string").alias("source_record_id"),
        F.col("row_number").alias("source_row_number"), F.col("location_id").cast("int").alias("sensor_id"),
        "sensor_name", day.alias("local_date"), F.col("hourday").cast("int").alias("local_hour"),
        total.alias("pedestrian_flow"), one.alias("direction_1_count"), two.alias("direction_2_count"),
        directions_valid(one, two, total).alias("direction_counts_valid"),
        F.lit("bidirectional_components").alias("direction_semantics"),
        F.col("_p.lat").alias("latitude"), F.col("_p.lon").alias("longitude"),
        F.lit(False).alias("hour_was_reconstructed"),
    )


def canonical(parts: list[DataFrame], sensors: DataFrame) -> DataFrame:
    """The canonical table of all snapshots; ``sensors`` is the current location list."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    known = sensors.select(F.col("location_id").cast("int").alias("sensor_id")).distinct().withColumn("_known", F.lit(True))
    named = rows.join(known, "sensor_id", "left").withColumns({
        "observed_at_local": at_hour(F.col("local_date"), F.col("local_hour")),
        "sensor_name": F.nullif(F.trim("sensor_name"), F.lit("")),
        "observation_key": hour_key(F.col("sensor_id"), F.col("local_date"), F.col("local_hour")),
    })
    status = F.col("_s")
    missing = F.col("latitude").isNull() | F.col("longitude").isNull()
    full = named.withColumn("_s", wall_status(F.col("observed_at_local"))).withColumns({
        "is_dst": status["is_dst"],
        "dst_ambiguous_local_time": status["ambiguous"],
        "dst_nonexistent_local_time": status["nonexistent"],
        "utc_offset_known": ~(status["ambiguous"] | status["nonexistent"]),
        "timezone_name": F.lit(MELBOURNE),
        "sensor_in_current_metadata": F.col("_known").isNotNull(),
        "sensor_name_missing": F.col("sensor_name").isNull(),
        "coordinate_missing": missing,
        "coordinate_valid": F.when(
            ~missing, F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
        ),
        **calendar_columns(F.col("local_date")),
    })
    return conform(full, struct_of(CROWD_DDL))


def validated(table: DataFrame) -> DataFrame:
    """The table itself, or an error for bad hours, negative totals or repeated keys."""
    return enforce(table, [
        Expectation("bad_hours", ~F.col("local_hour").between(0, 23)),
        Expectation("bad_totals", F.col("pedestrian_flow").isNull() | (F.col("pedestrian_flow") < 0)),
        Expectation("null_keys", F.col("sensor_id").isNull() | F.col("local_date").isNull() | F.col("local_hour").isNull()),
    ], CROWD_KEY)


def source_metrics(table: DataFrame) -> DataFrame:
    """Rows, date range and quality counters of each source."""
    return table.groupBy("source_dataset_id").agg(
        F.count(F.lit(1)).alias("selected_rows"), F.min("local_date").alias("min_date"), F.max("local_date").alias("max_date"),
        F.count_distinct("local_date").alias("dates"),
        F.count_if(F.col("pedestrian_flow") == 0).alias("zero_flow_rows"),
        F.count_if(~F.col("direction_counts_valid")).alias("invalid_direction_rows"),
        F.count_if("sensor_name_missing").alias("missing_sensor_name_rows"),
        F.count_if("coordinate_missing").alias("missing_coordinate_rows"),
        F.count_if(~F.col("coordinate_valid")).alias("invalid_coordinate_rows"),
        F.count_if(~F.col("sensor_in_current_metadata")).alias("missing_current_metadata_rows"),
        F.count_if("dst_ambiguous_local_time").alias("dst_ambiguous_rows"),
        F.count_if("dst_nonexistent_local_time").alias("dst_nonexistent_rows"),
        F.count_if("hour_was_reconstructed").alias("reconstructed_hour_rows"),
    )


def unit_coverage(table: DataFrame, unit: str, source: str, sources: dict[str, str], day: str, name: str, metadata: DataFrame | None = None) -> DataFrame:
    """Per unit its rows by source, date range and names; ``sources`` maps a column prefix to a source id.

    Names are distinct per unit before they are joined, so a busy unit sends a few rows only.
    """
    counts = table.groupBy(unit).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(day).alias("first_date"), F.max(day).alias("last_date"),
        *[F.count_if(F.col(source) == s).alias(f"{p}_rows") for p, s in sources.items()],
    )
    names = table.filter(F.col(name).isNotNull()).select(unit, name).distinct().groupBy(unit).agg(
        F.count(F.lit(1)).alias("distinct_names"), F.array_join(F.array_sort(F.collect_list(name)), " | ").alias("names")
    )
    out = counts.join(names, unit, "left").withColumns({
        "distinct_names": F.coalesce("distinct_names", F.lit(0)), "names": F.coalesce("names", F.lit("")),
    })
    if metadata is None:
        return out
    held = metadata.select(unit, *[F.col(c).alias(f"metadata_{c}") for c in metadata.columns if c != unit])
    return out.join(held.withColumn("_m", F.lit(True)), unit, "left").withColumn(
        "current_metadata_present", F.col("_m").isNotNull()
    ).drop("_m")
