"""Leakage-safe feature tables for one-hour-ahead forecasts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.functions.labels import mode_of
from hourspark.functions.numbers import sentinel_to_null
from hourspark.functions.timestamps import (
    MELBOURNE, cyclic, day_number, direction_components, floor_hour, plus, utc_to_local,
)
from hourspark.operators.hourly import hourly_means, hourly_medians, mode_counts
from hourspark.operators.metrics import feature_quality
from hourspark.operators.ordered import HISTORY_SLICE_HOURS, past_windows
from hourspark.operators.quality import mark_known, require_columns

# Split bounds of the two target tables.
CROWD_SPLITS = [("train", None, dt.date(2024, 12, 31)), ("validation", None, dt.date(2025, 12, 31)), ("test", None, dt.date(2026, 5, 11))]
TRAFFIC_FIRST = dt.date(2024, 1, 1)
TRAFFIC_SPLITS = [
    ("train", TRAFFIC_FIRST, dt.date(2024, 12, 31)), ("validation", dt.date(2025, 1, 1), dt.date(2025, 12, 31)),
    ("test", dt.date(2026, 1, 1), dt.date(2026, 7, 31)),
]
SPAN_SHARES = (0.70, 0.85)
RECENT_FIRST = dt.date(2023, 1, 1)

# Feed columns and the feature each becomes.
WEATHER_FEATURES = {
    "T2M": "nasa_temperature_c", "T2MDEW": "nasa_dewpoint_c", "RH2M": "nasa_relative_humidity_pct",
    "WS10M": "nasa_wind_speed_10m_m_s", "PS": "nasa_surface_pressure_kpa",
    "PRECTOTCORR": "nasa_precipitation_corrected_mm_h", "ALLSKY_SFC_SW_DWN": "nasa_surface_solar_radiation_w_m2",
}
MICRO_FEATURES = {
    "airtemperature": "micro_temperature_c_lag_1h", "relativehumidity": "micro_relative_humidity_pct_lag_1h",
    "atmosphericpressure": "micro_pressure_hpa_lag_1h", "averagewindspeed": "micro_wind_speed_m_s_lag_1h",
    "gustwindspeed": "micro_gust_speed_m_s_lag_1h", "pm25": "micro_pm25_ug_m3_lag_1h",
    "pm10": "micro_pm10_ug_m3_lag_1h", "noise": "micro_noise_db_lag_1h",
}


def split_by_date(day: Column, bounds: list[tuple[str, dt.date | None, dt.date]], otherwise: str) -> Column:
    """First split whose (first, last) dates hold the day."""
    cases = F
    for name, first, last in bounds:
        inside = day <= F.lit(last) if first is None else day.between(F.lit(first), F.lit(last))
        cases = cases.when(inside, name)
    return cases.otherwise(otherwise)


def split_by_span(df: DataFrame, instant: str, shares: tuple[float, float] = SPAN_SHARES) -> DataFrame:
    """Adds ``split``: the first 70 % of the time span train, the next 15 % validation, the rest test."""
    lo, hi = df.agg(F.min(instant).alias("lo"), F.max(instant).alias("hi")).first()
    # With fewer than two instants every row is train.
    edges = [str(lo + (hi - lo) * s) for s in shares] if lo is not None and hi != lo else None
    if edges is None:
        return df.withColumn("split", F.lit("train"))
    return df.withColumn("split", F.when(F.col(instant) < F.lit(edges[0]).cast("timestamp_ntz"), "train").when(
        F.col(instant) < F.lit(edges[1]).cast("timestamp_ntz"), "validation").otherwise("test"))


def split_bounds(df: DataFrame, day: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"), F.count(F.lit(1)).alias("rows"))


def split_faults(bounds: DataFrame, order: list[str]) -> DataFrame:
    """Neighbouring splits whose dates overlap; ``bounds`` has one row per split."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("split"))
    ranked = bounds.filter(place > 0).withColumn("p", place)
    return ranked.alias("a").join(ranked.alias("b"), F.col("b.p") == F.col("a.p") + 1).filter(
        F.col("b.min_date") <= F.col("a.max_date")
    ).select(F.col("a.split").alias("earlier"), F.col("b.split").alias("later"))


# Feeds -------------------------------------------------------------------------------------------


def feed_hour(df: DataFrame, instant: str, zone: str | None = MELBOURNE, name: str = "observed_at_local") -> DataFrame:
    """Adds the local hour of a UTC instant; with ``zone=None`` the instant is local already."""
    ts = F.col(instant).cast("timestamp_ntz")
    return df.withColumn(name, floor_hour(utc_to_local(ts, zone) if zone else ts))


def weather_feed(rows: DataFrame) -> DataFrame:
    """Hourly weather by local hour; the wind direction is averaged as sine and cosine."""
    require_columns(rows, ["timestamp_utc", "WD10M", *WEATHER_FEATURES], "weather")
    timed = feed_hour(rows.withColumn("timestamp_utc", F.regexp_replace(F.col("timestamp_utc").cast("string"), "Z$", "").try_cast("timestamp_ntz")), "timestamp_utc")
    sine, cosine = direction_components(sentinel_to_null(F.col("WD10M")))
    means = {n: sentinel_to_null(F.col(c)) for c, n in WEATHER_FEATURES.items()}
    means |= {"nasa_wind_direction_sin": sine, "nasa_wind_direction_cos": cosine}
    return hourly_means(timed, "observed_at_local", means, "nasa_weather_observation_count")


def microclimate_feed(rows: DataFrame) -> DataFrame:
    """Hourly median readings one hour late; absent reading columns stay null."""
    local = "timestamp_local" in rows.columns
    timed = feed_hour(rows, "timestamp_local" if local else "received_at", None if local else MELBOURNE)
    filled = timed.withColumns({
        c: (F.col(c) if c in rows.columns else F.lit(None)).try_cast("double") for c in MICRO_FEATURES
    })
    if "device_id" not in rows.columns:
        filled = filled.withColumn("device_id", F.lit(None).cast("string"))
    return hourly_medians(
        filled, "observed_at_local", {n: c for c, n in MICRO_FEATURES.items()}, "device_id",
        "micro_active_device_count_lag_1h", "micro_reading_count_lag_1h",
    )


def transport_feed(rows: DataFrame) -> DataFrame:
    """Hourly class counts by mode one hour late; the trailing Z of ``from`` is wall time."""
    if "timestamp_local" in rows.columns:
        wall = F.col("timestamp_local").cast("timestamp_ntz")
    else:
        require_columns(rows, ["from", "class", "count"], "class counts")
        wall = F.regexp_replace(F.regexp_replace(F.col("from").cast("string"), "Z$", ""), "T", " ").try_cast("timestamp_ntz")
    timed = rows.withColumn("observed_at_local", floor_hour(wall))
    place = "countLocationId" if "countLocationId" in rows.columns else None
    return mode_counts(timed, "observed_at_local", mode_of(F.col("class")), F.col("count").try_cast("double"), place)


# Tables ------------------------------------------------------------------------------------------


def calendar_features(day: Column, hour: Column, week_start: str, month: bool = True) -> dict[str, Column]:
    out = {**cyclic("hour", hour, 24.0), **cyclic("day_of_week", day_number(day, week_start), 7.0)}
    if month:
        out |= cyclic("month", F.month(day), 12.0)
    return out | cyclic("day_of_year", F.dayofyear(day), 365.25)


def base_table(
    df: DataFrame, instant: str, day: Column, hour: Column, split: Column | None, holidays: DataFrame | None = None,
    week_start: str = "monday", as_of: str = "feature_asof", horizon_hours: int = 1, month: bool = True,
) -> DataFrame:
    """Target rows with as-of time, horizon, split, cyclic calendar and holiday columns.

    Nothing of the target hour but its calendar enters.
    """
    out = df.withColumns({
        as_of: plus(F.col(instant), hours=-horizon_hours), "prediction_horizon_hours": F.lit(horizon_hours).cast("tinyint"),
        **({"split": split} if split is not None else {}), **calendar_features(day, hour, week_start, month),
    })
    if holidays is None:
        return out
    return out.withColumn("_day", day).join(
        holidays.withColumnRenamed("local_date", "_day"), "_day", "left"
    ).drop("_day")


def traffic_base(table: DataFrame, holidays: DataFrame) -> DataFrame:
    """Base table of the canonical vehicle counts; day of week as the cleaner stores it (Monday 0)."""
    return base_table(
        table, "hour_start_utc", F.col("local_date"), F.col("local_hour"),
        split_by_date(F.col("local_date"), TRAFFIC_SPLITS, "invalid_release_date"), holidays, "monday",
    )


def traffic_enhanced(base: DataFrame, slice_hours: int = HISTORY_SLICE_HOURS) -> DataFrame:
    """Lag-enhanced table: exact lags and past-only 24 h and 168 h statistics per source, scope and unit."""
    return past_windows(
        base, ["label_source", "measurement_scope", "observation_unit_id"], "hour_start_utc", "vehicle_count", slice_hours=slice_hours
    )


def crowd_table(table: DataFrame, holidays: DataFrame, weather: DataFrame, split: Column | None = None, slice_hours: int = HISTORY_SLICE_HOURS) -> DataFrame:
    """All-history table of the canonical pedestrian counts (Sunday 0, an empty 168 h count is 0)."""
    target = table.select(
        "observation_key", F.col("source_dataset_id").alias("target_source_dataset_id"), "sensor_id", "local_date", "local_hour",
        "observed_at_local", "pedestrian_flow", "is_dst", "dst_ambiguous_local_time", "dst_nonexistent_local_time",
        "hour_was_reconstructed",
    )
    lagged = past_windows(
        target, ["sensor_id"], "observed_at_local", "pedestrian_flow", means=(24,), deviations=(168,), counts=(168,),
        null_when_empty=False, prefix="flow", slice_hours=slice_hours,
    ).withColumnRenamed("flow_rolling_past_168h_stddev", "flow_rolling_past_168h_std")
    if split is None:
        split = split_by_date(F.col("local_date"), CROWD_SPLITS, "post_test")
    based = base_table(
        lagged, "observed_at_local", F.col("local_date"), F.col("local_hour"), split, holidays, "sunday", "feature_asof_local", month=False,
    ).withColumn("is_weekend", day_number(F.col("local_date"), "sunday").isin(0, 6))
    return based.join(weather, "observed_at_local", "left")


def recent_table(all_history: DataFrame, feeds: list[DataFrame], first: dt.date = RECENT_FIRST) -> DataFrame:
    """Recent rows with the lagged feeds; an hour without a feed row keeps nulls."""
    out = all_history.filter(F.col("local_date") >= F.lit(first))
    for feed in feeds:
        names = [c for c in feed.columns if c != "observed_at_local"]
        out = mark_known(out.join(feed, "observed_at_local", "left"), names)
    return out


def request_features(
    history: DataFrame, requests: DataFrame, unit: str, instant: str, value: str, slice_hours: int = HISTORY_SLICE_HOURS
) -> DataFrame:
    """Features of (unit, target hour) requests from the history, with coverage, warnings and status.

    Requests are laid into the history as rows without a value; such rows enter no statistic.
    """
    asked = requests.select(unit, instant, F.lit(None).cast(history.schema[value].dataType).alias(value), F.lit(True).alias("_ask"))
    known = history.select(unit, instant, value, F.lit(False).alias("_ask"))
    lagged = past_windows(known.unionByName(asked), [unit], instant, value, null_when_empty=True, slice_hours=slice_hours)
    rows = lagged.filter("_ask").drop("_ask", value)
    lags = [f"{value}_lag_{k}h" for k in (1, 24, 168)]
    features = [c for c in rows.columns if c not in (unit, instant)]
    return feature_quality(rows, features, lags)


def serving_features(history: DataFrame, unit: str, instant: str, value: str, slice_hours: int = HISTORY_SLICE_HOURS) -> DataFrame:
    """The request-time definition of the lag features, for skew reports against the training one.

    It counts lags from the as-of hour (one hour before the target), takes windows that end at the as-of
    hour and the population deviation.
    """
    return past_windows(
        history, [unit], instant, value, lags=(2, 25, 169), means=(24, 168), deviations=(168,), counts=(168,),
        null_when_empty=False, prefix="serving", slice_hours=slice_hours, deviation="population",
    )
