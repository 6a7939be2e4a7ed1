"""Hourly counts, lags, rolling statistics, feeds and feature tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.functions.holidays import holiday_calendar
from hourspark.functions.labels import mode_of
from hourspark.functions.timestamps import epoch_micros, floor_hour, plus
from hourspark.operators import hourly, ordered
from hourspark.operators.quality import conform
from hourspark.plans import features as feats
from hourspark.queries import Tables, query, rounded
from hourspark.schemas import CROWD_DDL, struct_of

HOURLY = "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2"
SPLITS = [("train", None, dt.date(2024, 1, 18)), ("validation", None, dt.date(2024, 1, 24)), ("test", None, dt.date(2024, 1, 31))]
SPLIT_SQL = """CASE WHEN hour::DATE <= DATE '2024-01-18' THEN 'train' WHEN hour::DATE <= DATE '2024-01-24' THEN 'validation'
  WHEN hour::DATE <= DATE '2024-01-31' THEN 'test' ELSE 'post_test' END"""


def hourly_events(t: Tables) -> DataFrame:
    return hourly.hourly_counts(t.events, ["user_id"], floor_hour(F.col("ts")))


def lagged_events(t: Tables) -> DataFrame:
    return ordered.past_windows(hourly_events(t), ["user_id"], "hour", "n")


LAGGED = f"""
SELECT user_id, hour, n,
  max(n) OVER (PARTITION BY user_id ORDER BY hour RANGE BETWEEN INTERVAL 1 HOURS PRECEDING AND INTERVAL 1 HOURS PRECEDING) AS n_lag_1h,
  max(n) OVER (PARTITION BY user_id ORDER BY hour RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 24 HOURS PRECEDING) AS n_lag_24h,
  max(n) OVER (PARTITION BY user_id ORDER BY hour RANGE BETWEEN INTERVAL 168 HOURS PRECEDING AND INTERVAL 168 HOURS PRECEDING) AS n_lag_168h,
  avg(n) OVER d AS n_rolling_past_24h_mean,
  avg(n) OVER w AS n_rolling_past_168h_mean,
  stddev_samp(n) OVER d AS n_rolling_past_24h_stddev,
  stddev_samp(n) OVER w AS n_rolling_past_168h_stddev,
  nullif(count(n) OVER d, 0) AS n_rolling_past_24h_count,
  nullif(count(n) OVER w, 0) AS n_rolling_past_168h_count
FROM ({HOURLY}) h
WINDOW d AS (PARTITION BY user_id ORDER BY hour RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
       w AS (PARTITION BY user_id ORDER BY hour RANGE BETWEEN INTERVAL 168 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)
"""
ROLLING = ["n_rolling_past_24h_mean", "n_rolling_past_168h_mean", "n_rolling_past_24h_stddev", "n_rolling_past_168h_stddev"]
CYCLES_SQL = """
  round(sin(2 * pi() * hour(hour) / 24.0), 6) AS hour_sin, round(cos(2 * pi() * hour(hour) / 24.0), 6) AS hour_cos,
  round(sin(2 * pi() * dayofweek(hour) / 7.0), 6) AS day_of_week_sin, round(cos(2 * pi() * dayofweek(hour) / 7.0), 6) AS day_of_week_cos,
  round(sin(2 * pi() * month(hour) / 12.0), 6) AS month_sin, round(cos(2 * pi() * month(hour) / 12.0), 6) AS month_cos,
  round(sin(2 * pi() * dayofyear(hour) / 365.25), 6) AS day_of_year_sin, round(cos(2 * pi() * dayofyear(hour) / 365.25), 6) AS day_of_year_cos"""
CYCLES = [f"{c}_{f}" for c in ("hour", "day_of_week", "month", "day_of_year") for f in ("sin", "cos")]


@query(HOURLY)
def hourly_counts(t: Tables) -> DataFrame:
    return hourly_events(t)


@query(f"""SELECT user_id, hour, n, hour - INTERVAL 1 HOUR AS feature_asof, 1::TINYINT AS prediction_horizon_hours, {SPLIT_SQL} AS split, {CYCLES_SQL},
  n_lag_1h, n_lag_24h, n_lag_168h, {', '.join(f'round({c}, 6) AS {c}' for c in ROLLING)}, n_rolling_past_24h_count, n_rolling_past_168h_count
  FROM ({LAGGED}) l""")
def lag_enhanced_features(t: Tables) -> DataFrame:
    base = feats.base_table(
        hourly_events(t), "hour", F.to_date("hour"), F.hour("hour"), feats.split_by_date(F.to_date("hour"), SPLITS, "post_test"),
        week_start="sunday",
    )
    return rounded(ordered.past_windows(base, ["user_id"], "hour", "n"), *CYCLES, *ROLLING)


@query(f"""WITH h AS ({HOURLY}) SELECT h.user_id, h.hour, h.n, a.n AS n_lag_1h, b.n AS n_lag_24h, c.n AS n_lag_168h FROM h
  LEFT JOIN h a ON a.user_id = h.user_id AND a.hour = h.hour - INTERVAL 1 HOUR
  LEFT JOIN h b ON b.user_id = h.user_id AND b.hour = h.hour - INTERVAL 24 HOUR
  LEFT JOIN h c ON c.user_id = h.user_id AND c.hour = h.hour - INTERVAL 168 HOUR""")
def lag_by_self_join(t: Tables) -> DataFrame:
    return ordered.shifted_lags(hourly_events(t), ["user_id"], "hour", "n")


@query(f"""SELECT user_id, hour, n,
  max(n) OVER (PARTITION BY user_id ORDER BY hour RANGE BETWEEN INTERVAL 1 HOURS PRECEDING AND INTERVAL 1 HOURS PRECEDING) AS n_lag_1h,
  round(avg(n) OVER d, 6) AS n_rolling_past_24h_mean, round(stddev_samp(n) OVER w, 6) AS n_rolling_past_168h_stddev, count(n) OVER w AS n_rolling_past_168h_count
  FROM ({HOURLY}) h
  WINDOW d AS (PARTITION BY user_id ORDER BY hour RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
         w AS (PARTITION BY user_id ORDER BY hour RANGE BETWEEN INTERVAL 168 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""")
def rolling_past_windows(t: Tables) -> DataFrame:
    out = ordered.past_windows(
        hourly_events(t), ["user_id"], "hour", "n", lags=(1,), means=(24,), deviations=(168,), counts=(168,), null_when_empty=False,
    )
    return rounded(out, "n_rolling_past_24h_mean", "n_rolling_past_168h_stddev")


EASTER_SQL = """
  easter AS (SELECT y, (y % 19) AS a, y // 100 AS b, y % 100 AS c FROM years),
  easter2 AS (SELECT y, a, c, b, (19*a + b - b//4 - (8*b+13)//25 + 15) % 30 AS h FROM easter),
  easter3 AS (SELECT y, a, h, (2*(b%4) + 2*(c//4) - h - (c%4) + 32) % 7 AS m FROM easter2),
  easter4 AS (SELECT y, h + m - 7*((a + 11*h + 22*m)//451) + 114 AS q FROM easter3),
  sunday AS (SELECT y, make_date(y, q // 31, q % 31 + 1) AS e FROM easter4)"""
HOLIDAY_SQL = f"""
WITH bounds AS (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders),
  days AS (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS local_date FROM bounds),
  years AS (SELECT DISTINCT year(local_date) AS y FROM days), {EASTER_SQL},
  fixed AS (SELECT y, e, make_date(y,1,1) AS ny, make_date(y,1,26) AS au, make_date(y,12,25) AS xm, make_date(y,12,26) AS bx FROM sunday),
  rules AS (
    SELECT ny AS d, 'New Year''s Day' AS nm FROM fixed
    UNION ALL SELECT ny + (CASE isodow(ny) WHEN 6 THEN 2 ELSE 1 END)::INTEGER, 'New Year''s Day (observed)' FROM fixed WHERE isodow(ny) >= 6
    UNION ALL SELECT au + (CASE isodow(au) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)::INTEGER, 'Australia Day' FROM fixed
    UNION ALL SELECT make_date(y,3,1) + ((8 - isodow(make_date(y,3,1))) % 7 + 7)::INTEGER, 'Labour Day' FROM fixed
    UNION ALL SELECT e - 2, 'Good Friday' FROM fixed
    UNION ALL SELECT e - 1, 'Easter Saturday' FROM fixed
    UNION ALL SELECT e, 'Easter Sunday' FROM fixed
    UNION ALL SELECT e + 1, 'Easter Monday' FROM fixed
    UNION ALL SELECT make_date(y,4,25), 'Anzac Day' FROM fixed
    UNION ALL SELECT make_date(y,6,1) + ((8 - isodow(make_date(y,6,1))) % 7 + 7)::INTEGER, 'King''s Birthday' FROM fixed
    UNION ALL SELECT make_date(y,11,1) + ((9 - isodow(make_date(y,11,1))) % 7)::INTEGER, 'Melbourne Cup' FROM fixed
    UNION ALL SELECT xm, 'Christmas Day' FROM fixed
    UNION ALL SELECT xm + 2, 'Christmas Day (observed)' FROM fixed WHERE isodow(xm) >= 6
    UNION ALL SELECT bx, 'Boxing Day' FROM fixed
    UNION ALL SELECT bx + 2, 'Boxing Day (observed)' FROM fixed WHERE isodow(bx) >= 6),
  named AS (SELECT d::DATE AS local_date, string_agg(DISTINCT nm, '; ' ORDER BY nm) AS public_holiday_name FROM rules GROUP BY 1)
"""


def order_holidays(t: Tables) -> DataFrame:
    bounds = t.orders.agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return holiday_calendar(bounds, "lo", "hi")


@query(HOLIDAY_SQL + "SELECT local_date, public_holiday_name IS NOT NULL AS is_public_holiday, public_holiday_name FROM days LEFT JOIN named USING (local_date)")
def holiday_calendar_days(t: Tables) -> DataFrame:
    return order_holidays(t)


@query(HOLIDAY_SQL + """, daily AS (SELECT o_orderpriority AS unit, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT unit, day, n, day::TIMESTAMP - INTERVAL 1 HOUR AS feature_asof, 1::TINYINT AS prediction_horizon_hours,
  CASE WHEN day <= DATE '1998-12-31' THEN 'train' WHEN day <= DATE '1999-12-31' THEN 'validation' WHEN day <= DATE '2000-12-31' THEN 'test' ELSE 'post_test' END AS split,
  round(sin(2*pi()*0/24.0), 6) AS hour_sin, round(cos(2*pi()*0/24.0), 6) AS hour_cos,
  round(sin(2*pi()*(isodow(day)-1)/7.0), 6) AS day_of_week_sin, round(cos(2*pi()*(isodow(day)-1)/7.0), 6) AS day_of_week_cos,
  round(sin(2*pi()*month(day)/12.0), 6) AS month_sin, round(cos(2*pi()*month(day)/12.0), 6) AS month_cos,
  round(sin(2*pi()*dayofyear(day)/365.25), 6) AS day_of_year_sin, round(cos(2*pi()*dayofyear(day)/365.25), 6) AS day_of_year_cos,
  public_holiday_name IS NOT NULL AS is_public_holiday, public_holiday_name
FROM daily LEFT JOIN named ON local_date = day""")
def base_features(t: Tables) -> DataFrame:
    daily = t.orders.groupBy(F.col("o_orderpriority").alias("unit"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    bounds = [("train", None, dt.date(1998, 12, 31)), ("validation", None, dt.date(1999, 12, 31)), ("test", None, dt.date(2000, 12, 31))]
    timed = daily.withColumn("_at", F.col("day").cast("timestamp_ntz"))
    out = feats.base_table(timed, "_at", F.col("day"), F.lit(0), feats.split_by_date(F.col("day"), bounds, "post_test"), order_holidays(t))
    return rounded(out.drop("_at"), *CYCLES)


FEEDS_SQL = """
  means AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS mean_value, avg(sin(value * pi() / 180)) AS wind_sin, avg(cos(value * pi() / 180)) AS wind_cos,
    count(*) AS readings FROM events GROUP BY 1),
  medians AS (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour, median(value) AS median_value, count(DISTINCT user_id) AS devices, count(*) AS median_readings FROM events GROUP BY 1),
  modes AS (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour,
    sum(CASE WHEN event_type = 'click' THEN value END) AS transport_vehicle_count_lag_1h, sum(CASE WHEN event_type = 'view' THEN value END) AS transport_cyclist_count_lag_1h,
    sum(CASE WHEN event_type = 'signup' THEN value END) AS transport_pedestrian_count_lag_1h, sum(CASE WHEN event_type IN ('error', 'purchase') THEN value END) AS transport_other_count_lag_1h,
    count(DISTINCT user_id) AS transport_active_location_count_lag_1h, count(*) AS transport_observation_count_lag_1h FROM events WHERE value >= 0 GROUP BY 1)"""
MODE_COLUMNS = [f"transport_{m}_count_lag_1h" for m in ("vehicle", "cyclist", "pedestrian", "other")]


def feed_events(t: Tables) -> DataFrame:
    label = F.when(F.col("event_type") == "click", "Truck").when(F.col("event_type") == "view", "bicycle").when(
        F.col("event_type") == "signup", "walker").otherwise("unknown")
    return t.events.select(floor_hour(F.col("ts")).alias("hour"), "user_id", "value", label.alias("class"))


def mean_feed(t: Tables) -> DataFrame:
    sine, cosine = F.sin(F.col("value") * F.pi() / 180), F.cos(F.col("value") * F.pi() / 180)
    return hourly.hourly_means(feed_events(t), "hour", {"mean_value": F.col("value"), "wind_sin": sine, "wind_cos": cosine}, "readings")


def median_feed(t: Tables) -> DataFrame:
    return hourly.hourly_medians(feed_events(t), "hour", {"median_value": "value"}, "user_id", "devices", "median_readings")


def mode_feed(t: Tables) -> DataFrame:
    return hourly.mode_counts(feed_events(t), "hour", mode_of(F.col("class")), F.col("value"), "user_id")


@query(f"WITH {FEEDS_SQL} SELECT hour, round(mean_value, 6) AS mean_value, round(wind_sin, 6) AS wind_sin, round(wind_cos, 6) AS wind_cos, readings FROM means")
def feed_mean(t: Tables) -> DataFrame:
    return rounded(mean_feed(t), "mean_value", "wind_sin", "wind_cos")


@query(f"WITH {FEEDS_SQL} SELECT hour, round(median_value, 6) AS median_value, devices, median_readings FROM medians")
def feed_median_shifted(t: Tables) -> DataFrame:
    return rounded(median_feed(t), "median_value")


@query(f"""WITH {FEEDS_SQL} SELECT hour, {', '.join(f'round({c}, 4) AS {c}' for c in MODE_COLUMNS)},
  transport_active_location_count_lag_1h, transport_observation_count_lag_1h FROM modes""")
def class_pivot(t: Tables) -> DataFrame:
    return rounded(mode_feed(t), *MODE_COLUMNS, digits=4)


@query(f"""WITH {FEEDS_SQL}, h AS ({HOURLY}) SELECT user_id, hour, n, round(mean_value, 6) AS mean_value, readings, round(median_value, 6) AS median_value, devices,
  round(transport_vehicle_count_lag_1h, 4) AS vehicles FROM h LEFT JOIN means USING (hour) LEFT JOIN medians USING (hour) LEFT JOIN modes USING (hour)
  WHERE hour::DATE >= DATE '2024-01-10'""")
def recent_enhanced_features(t: Tables) -> DataFrame:
    base = hourly_events(t).withColumn("local_date", F.to_date("hour")).withColumnRenamed("hour", "observed_at_local")
    feeds = [f.withColumnRenamed("hour", "observed_at_local") for f in (mean_feed(t), median_feed(t), mode_feed(t))]
    out = feats.recent_table(base, feeds, dt.date(2024, 1, 10))
    return out.select(
        "user_id", F.col("observed_at_local").alias("hour"), "n", F.round("mean_value", 6).alias("mean_value"), "readings",
        F.round("median_value", 6).alias("median_value"), "devices", F.round("transport_vehicle_count_lag_1h", 4).alias("vehicles"),
    )


REQUEST_SQL = f"""
h AS ({HOURLY}), q AS (SELECT user_id, max(hour) + INTERVAL 1 HOUR AS hour FROM h GROUP BY 1),
r AS (SELECT q.user_id, q.hour,
  max(CASE WHEN h.hour = q.hour - INTERVAL 1 HOUR THEN n END) AS n_lag_1h,
  max(CASE WHEN h.hour = q.hour - INTERVAL 24 HOUR THEN n END) AS n_lag_24h,
  max(CASE WHEN h.hour = q.hour - INTERVAL 168 HOUR THEN n END) AS n_lag_168h,
  avg(CASE WHEN h.hour >= q.hour - INTERVAL 24 HOUR THEN n END) AS n_rolling_past_24h_mean,
  avg(CASE WHEN h.hour >= q.hour - INTERVAL 168 HOUR THEN n END) AS n_rolling_past_168h_mean,
  stddev_samp(CASE WHEN h.hour >= q.hour - INTERVAL 24 HOUR THEN n END) AS n_rolling_past_24h_stddev,
  stddev_samp(CASE WHEN h.hour >= q.hour - INTERVAL 168 HOUR THEN n END) AS n_rolling_past_168h_stddev,
  nullif(count(CASE WHEN h.hour >= q.hour - INTERVAL 24 HOUR THEN n END), 0) AS n_rolling_past_24h_count,
  nullif(count(CASE WHEN h.hour >= q.hour - INTERVAL 168 HOUR THEN n END), 0) AS n_rolling_past_168h_count
  FROM q JOIN h ON h.user_id = q.user_id AND h.hour < q.hour GROUP BY 1, 2)"""
REQUEST_FEATURES = ["n_lag_1h", "n_lag_24h", "n_lag_168h", *ROLLING, "n_rolling_past_24h_count", "n_rolling_past_168h_count"]


@query(f"""WITH {REQUEST_SQL} SELECT user_id, hour, n_lag_1h, n_lag_24h, n_lag_168h, {', '.join(f'round({c}, 6) AS {c}' for c in ROLLING)},
  n_rolling_past_24h_count, n_rolling_past_168h_count,
  round(({' + '.join(f'({c} IS NOT NULL)::INT' for c in REQUEST_FEATURES)}) / 9.0, 6) AS feature_coverage,
  concat_ws(';', CASE WHEN n_lag_1h IS NULL THEN 'missing_n_lag_1h' END, CASE WHEN n_lag_24h IS NULL THEN 'missing_n_lag_24h' END, CASE WHEN n_lag_168h IS NULL THEN 'missing_n_lag_168h' END) AS warnings,
  CASE WHEN coalesce(n_lag_1h, n_lag_24h, n_lag_168h) IS NULL THEN 'unavailable' WHEN n_lag_1h IS NULL OR n_lag_24h IS NULL OR n_lag_168h IS NULL THEN 'degraded' ELSE 'ok' END AS status
  FROM r""")
def request_features(t: Tables) -> DataFrame:
    history = hourly_events(t)
    requests = history.groupBy("user_id").agg(plus(F.max("hour"), hours=1).alias("hour"))
    out = feats.request_features(history, requests, "user_id", "hour", "n")
    return rounded(out, *ROLLING, "feature_coverage").withColumn("warnings", F.array_join("warnings", ";"))


@query(f"""WITH h AS ({HOURLY}), s AS (SELECT user_id, hour, n,
    max(n) OVER (PARTITION BY user_id ORDER BY hour RANGE BETWEEN INTERVAL 1 HOURS PRECEDING AND INTERVAL 1 HOURS PRECEDING) AS train_lag,
    max(n) OVER (PARTITION BY user_id ORDER BY hour RANGE BETWEEN INTERVAL 2 HOURS PRECEDING AND INTERVAL 2 HOURS PRECEDING) AS serve_lag,
    stddev_samp(n) OVER w AS train_std, stddev_pop(n) OVER w AS serve_std, avg(n) OVER w AS serve_mean FROM h
    WINDOW w AS (PARTITION BY user_id ORDER BY hour RANGE BETWEEN INTERVAL 168 HOURS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
  SELECT count(*) AS rows, count(*) FILTER (WHERE train_lag IS DISTINCT FROM serve_lag) AS lag_1h_differs,
    count(*) FILTER (WHERE round(train_std, 6) IS DISTINCT FROM round(serve_std, 6)) AS std_differs, round(avg(serve_mean), 6) AS serving_mean FROM s""")
def serving_skew_report(t: Tables) -> DataFrame:
    history = hourly_events(t)
    train = ordered.past_windows(history, ["user_id"], "hour", "n")
    both = feats.serving_features(train, "user_id", "hour", "n")
    differs = lambda a, b: F.count_if(~F.round(a, 6).eqNullSafe(F.round(b, 6)))
    return both.agg(
        F.count(F.lit(1)).alias("rows"), differs("n_lag_1h", "serving_lag_2h").alias("lag_1h_differs"),
        differs("n_rolling_past_168h_stddev", "serving_rolling_past_168h_stddev").alias("std_differs"),
        F.round(F.avg("serving_rolling_past_168h_mean"), 6).alias("serving_mean"),
    )


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
  lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_event,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running_value FROM events""")
def running_totals(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "value")
    part = ordered.slice_of(epoch_micros(F.col("ts")), ordered.DAY_MICROS)
    out = ordered.running(rows, ["user_id"], ["ts", "event_id"], part, {"rn": ("count", F.lit(1)), "running_value": ("sum", F.col("value"))})
    out = ordered.neighbour(out, ["user_id"], ["ts", "event_id"], part, ["event_id"])
    return out.select("event_id", "user_id", "rn", F.col("prev.event_id").alias("previous_event"), F.round("running_value", 4).alias("running_value"))


@query("""SELECT event_type, user_id, value, round(score, 6) AS score
  FROM (SELECT *, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS score FROM events)
  QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""")
def empirical_cdf(t: Tables) -> DataFrame:
    """Score of each user's newest value against the distribution of its event type."""
    reference = ordered.cumulative_share(t.events, ["event_type"], "value", 10.0, "score")
    asked = ordered.latest(t.events.select("event_type", "user_id", "value", "ts", "event_id"), ["event_type", "user_id"], ["ts", "event_id"])
    found = ordered.step_lookup(reference, asked.select("event_type", "user_id", "value"), ["event_type"], "value", "score", 10.0)
    return found.select("event_type", "user_id", "value", F.round(F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)), 6).alias("score"))


CROWD_FEATURES_SQL = f"""
  w AS (SELECT date_trunc('hour', ts) + INTERVAL 11 HOUR AS hour, avg(CASE WHEN event_type <> 'error' THEN value END) AS warm, avg(CASE WHEN event_type <> 'error' THEN value / 2 END) AS dew,
    avg(sin(radians(value))) AS wind_sin, avg(cos(radians(value))) AS wind_cos, count(*) AS observations FROM events GROUP BY 1),
  c AS (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour, median(value) AS micro, median(value * 2) AS noise, count(DISTINCT user_id) AS devices, count(*) AS readings,
    sum(CASE WHEN event_type = 'click' THEN value END) AS vehicles, sum(CASE WHEN event_type = 'view' THEN value END) AS cyclists FROM events GROUP BY 1)"""


@query(f"""WITH {CROWD_FEATURES_SQL.lstrip()}, h AS ({LAGGED})
  SELECT user_id::INTEGER AS sensor_id, h.hour AS observed_at_local, n AS pedestrian_flow, h.hour - INTERVAL 1 HOUR AS feature_asof_local, 'train' AS split, isodow(h.hour) >= 6 AS is_weekend,
    CASE h.hour::DATE WHEN DATE '2024-01-01' THEN 'New Year''s Day' WHEN DATE '2024-01-26' THEN 'Australia Day' END AS public_holiday_name,
    n_lag_1h AS flow_lag_1h, n_lag_168h AS flow_lag_168h, round(n_rolling_past_24h_mean, 6) AS flow_rolling_past_24h_mean, round(n_rolling_past_168h_stddev, 6) AS flow_rolling_past_168h_std,
    coalesce(n_rolling_past_168h_count, 0) AS flow_rolling_past_168h_count, round(warm, 6) AS nasa_temperature_c, round(dew, 6) AS nasa_dewpoint_c, round(wind_sin, 6) AS nasa_wind_direction_sin,
    round(wind_cos, 6) AS nasa_wind_direction_cos, observations AS nasa_weather_observation_count, round(micro, 6) AS micro_temperature_c_lag_1h, round(noise, 6) AS micro_noise_db_lag_1h,
    NULL::DOUBLE AS micro_pm25_ug_m3_lag_1h, devices AS micro_active_device_count_lag_1h, readings AS micro_reading_count_lag_1h, round(vehicles, 4) AS transport_vehicle_count_lag_1h,
    round(cyclists, 4) AS transport_cyclist_count_lag_1h
  FROM h LEFT JOIN w USING (hour) LEFT JOIN c USING (hour)""")
def crowd_features(t: Tables) -> DataFrame:
    """The whole pedestrian feature build: lags, calendar, holidays, weather, and the late micro-climate and class feeds."""
    hours = hourly_events(t).withColumnRenamed("hour", "observed_at_local")
    table = conform(hours.select(
        F.concat_ws(":", "user_id", "observed_at_local").alias("observation_key"), F.lit("events").alias("source_dataset_id"), F.col("user_id").cast("int").alias("sensor_id"),
        F.to_date("observed_at_local").alias("local_date"), F.hour("observed_at_local").alias("local_hour"), "observed_at_local", F.col("n").alias("pedestrian_flow"),
    ), struct_of(CROWD_DDL))
    stamp = F.concat(F.substring(F.col("ts").cast("timestamp_ntz").cast("string"), 1, 19), F.lit("Z"))
    reading = F.when(F.col("event_type") == "error", F.lit(-999.0)).otherwise(F.col("value"))
    weather = t.events.select(
        stamp.alias("timestamp_utc"), F.col("value").alias("WD10M"), reading.alias("T2M"), F.when(reading == -999.0, reading).otherwise(reading / 2).alias("T2MDEW"),
        *[F.lit(None).cast("double").alias(c) for c in feats.WEATHER_FEATURES if not c.startswith("T2M")],
    )
    climate = t.events.select(F.col("ts").cast("timestamp_ntz").alias("timestamp_local"), F.col("user_id").cast("string").alias("device_id"), F.col("value").alias("airtemperature"), (F.col("value") * 2).alias("noise"))
    kinds = F.when(F.col("event_type") == "click", "Car").when(F.col("event_type") == "view", "cyclist").otherwise("thing")
    classes = t.events.select(stamp.alias("from"), kinds.alias("class"), F.col("value").cast("string").alias("count"), F.col("user_id").alias("countLocationId"))
    bounds = t.events.agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
    whole = feats.crowd_table(table, holiday_calendar(bounds, "lo", "hi"), feats.weather_feed(weather))
    out = feats.recent_table(whole, [feats.microclimate_feed(climate), feats.transport_feed(classes)])
    six = ["flow_rolling_past_24h_mean", "flow_rolling_past_168h_std", "nasa_temperature_c", "nasa_dewpoint_c", "nasa_wind_direction_sin", "nasa_wind_direction_cos", "micro_temperature_c_lag_1h", "micro_noise_db_lag_1h"]
    four = ["transport_vehicle_count_lag_1h", "transport_cyclist_count_lag_1h"]
    kept = out.select(
        "sensor_id", "observed_at_local", "pedestrian_flow", "feature_asof_local", "split", "is_weekend", "public_holiday_name", "flow_lag_1h", "flow_lag_168h", "flow_rolling_past_168h_count",
        "nasa_weather_observation_count", "micro_pm25_ug_m3_lag_1h", "micro_active_device_count_lag_1h", "micro_reading_count_lag_1h", *six, *four,
    )
    return rounded(rounded(kept, *six), *four, digits=4)
