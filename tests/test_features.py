import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourspark.operators import quality
from hourspark.operators.ordered import past_windows
from hourspark.operators.quality import ContractError
from hourspark.plans import features as feats
from hourspark.schemas import CROWD_DDL, ROLE_ALIASES, TRAFFIC_DDL, feature_lists, struct_of
from hourspark.session import cut


def stamped(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def crowd(spark, *data):
    df = stamped(spark, "sensor_id int, t string, pedestrian_flow long", *data)
    at = F.col("t").cast("timestamp_ntz")
    full = df.withColumns({"observed_at_local": at, "local_date": F.to_date(at), "local_hour": F.hour(at), "observation_key": F.concat_ws(":", "sensor_id", "t")})
    return quality.conform(full, struct_of(CROWD_DDL))


def holidays(spark):
    return spark.sql("SELECT DATE '2025-01-26' AS local_date, true AS is_public_holiday, 'Australia Day' AS public_holiday_name")


def weather(spark, *data):
    cols = ["timestamp_utc", "T2M", "T2MDEW", "RH2M", "WS10M", "WD10M", "PS", "PRECTOTCORR", "ALLSKY_SFC_SW_DWN"]
    return feats.weather_feed(spark.createDataFrame([tuple(str(x) for x in r) for r in data], ", ".join(f"{c} string" for c in cols)))


def test_crowd_lags_stay_in_their_sensor_and_null_over_gaps(spark):
    table = crowd(spark, (1, "2025-01-26 10:00:00", 100), (1, "2025-01-26 12:00:00", 300), (1, "2025-01-26 13:00:00", 400), (2, "2025-01-26 12:00:00", 900), (2, "2025-01-26 13:00:00", 1000))
    feed = weather(spark, ("2025-01-26T02:00:00Z", 20, 1, 1, 1, 90, 1, 1, -999))
    out = {(r.sensor_id, r.local_hour): r for r in feats.crowd_table(table, holidays(spark), feed).collect()}
    assert [out[k].flow_lag_1h for k in ((1, 10), (1, 12), (1, 13), (2, 13))] == [None, None, 300, 900]
    row = out[1, 13]
    assert (row.split, row.is_weekend, row.is_public_holiday, row.flow_rolling_past_168h_count) == ("validation", True, True, 2)
    assert out[1, 10].flow_rolling_past_168h_count == 0
    assert row.feature_asof_local == dt.datetime(2025, 1, 26, 12)
    assert (row.nasa_temperature_c, row.nasa_surface_solar_radiation_w_m2, round(row.nasa_wind_direction_sin, 9)) == (20.0, None, 1.0)
    assert out[1, 12].nasa_temperature_c is None


def test_feeds_are_lagged_and_never_from_the_same_hour(spark):
    rows = stamped(
        spark, "`from` string, `class` string, `count` string, countLocationId string",
        ("2025-01-26T12:05:00Z", "car", "100", "1"), ("2025-01-26T12:50:00Z", "ute", "11", "2"), ("2025-01-26T13:00:00Z", "car", "999", "1"), ("2025-01-26T12:00:00Z", "walker", "-4", "3"),
    )
    feed = feats.transport_feed(rows)
    base = stamped(spark, "t string", ("2025-01-26 13:00:00",), ("2025-01-27 13:00:00",)).select(F.col("t").cast("timestamp_ntz").alias("observed_at_local"), F.to_date("t").alias("local_date"))
    first, second = feats.recent_table(base, [feed], dt.date(2023, 1, 1)).orderBy("observed_at_local").collect()
    assert (first.transport_vehicle_count_lag_1h, first.transport_active_location_count_lag_1h, first.transport_observation_count_lag_1h) == (111.0, 2, 2)
    assert first.transport_pedestrian_count_lag_1h is None
    assert second.transport_vehicle_count_lag_1h is None and second.transport_observation_count_lag_1h is None


def test_microclimate_is_an_exact_median_one_hour_late(spark):
    rows = stamped(spark, "device_id string, received_at string, airtemperature double, noise double",
                   ("a", "2025-01-26 02:10:00", 20.0, 50.0), ("a", "2025-01-26 02:40:00", 30.0, None), ("b", "2025-01-26 02:50:00", 21.0, 60.0))
    row = feats.microclimate_feed(rows).first()
    assert (row.observed_at_local, row.micro_temperature_c_lag_1h, row.micro_noise_db_lag_1h) == (dt.datetime(2025, 1, 26, 14), 21.0, 55.0)
    assert (row.micro_active_device_count_lag_1h, row.micro_reading_count_lag_1h, row.micro_pm25_ug_m3_lag_1h) == (2, 3, None)


def test_traffic_split_uses_the_local_date(spark):
    df = stamped(spark, "t string", ("2024-12-31 12:00:00",), ("2024-12-31 13:00:00",), ("2025-12-31 12:00:00",), ("2025-12-31 13:00:00",), ("2027-01-01 00:00:00",))
    from hourspark.functions.timestamps import utc_to_local

    day = F.to_date(utc_to_local(F.col("t").cast("timestamp_ntz")))
    got = [r[0] for r in df.select(feats.split_by_date(day, feats.TRAFFIC_SPLITS, "invalid_release_date")).collect()]
    assert got == ["train", "validation", "validation", "test", "invalid_release_date"]


def test_split_by_span_of_short_history(spark):
    df = spark.range(100).select((F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"), F.lit(0), F.lit(0))).alias("t"))
    got = {r.split: r["count"] for r in feats.split_by_span(df, "t").groupBy("split").count().collect()}
    assert got == {"train": 70, "validation": 15, "test": 15}


def test_features_that_leak_are_found(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0)], "u string, t timestamp_ntz, vehicle_count double")
    df = past_windows(df, ["u"], "t", "vehicle_count").withColumns(feats.calendar_features(F.to_date("t"), F.hour("t"), "monday"))
    df = df.withColumns({"vehicle_count_rolling_mean": F.col("vehicle_count") + F.col("vehicle_count_lag_1h"), "split": F.lit("train")})
    allowed = ["vehicle_count_lag_1h", "vehicle_count_rolling_past_24h_mean", "hour_sin"]
    banned = ["vehicle_count", "vehicle_count_rolling_mean", "split", "t", "no_such_column"]
    assert quality.leaking_features(df, [*allowed, *banned]) == sorted(banned)
    assert quality.leaking_features(cut(df.join(df.select("u"), "u")), allowed) == []  # marks follow joins and written tables
    assert quality.leaking_features(df, allowed, ["hour_sin"]) == ["hour_sin"]
    with pytest.raises(ContractError):
        quality.enforce_features(df, ["hour_sin", "hour_sin"])


def test_feature_roles_leave_out_diagnostics():
    lists = feature_lists(struct_of(TRAFFIC_DDL).fieldNames() + ["hour_sin", "vehicle_count_lag_1h"], ["vehicle_count_lag_1h"])
    assert "vehicle_count_lag_1h" in lists["numeric_features"] and "hour_sin" in lists["numeric_features"]
    assert not set(lists["feature_columns"]) & {"vehicle_count", "label_quality", "ta_derived_zero", "label_source"}
    assert not {n.lower() for n in lists["feature_columns"]} & {n.lower() for n in quality.AUDIT_COLUMNS}
    assert {"label_source", "label_quality", "vehicle_count_lag_1h"} <= set(lists["available_columns"]) and "vehicle_count" not in lists["available_columns"]
    assert "public_holiday_name" in feature_lists(["public_holiday_name"])["categorical_features"]


def test_roles_resolve_to_the_first_alias(spark):
    df = spark.createDataFrame([(1, 2)], "traffic_lag_1h int, lag_1h int")
    assert quality.resolve_role(df, ROLE_ALIASES["lag_1h"], "lag_1h") == "traffic_lag_1h"
    with pytest.raises(ContractError):
        quality.resolve_role(df, ROLE_ALIASES["split"], "split")
    odd = df.withColumnRenamed("lag_1h", "Vehicle Lag-24h")
    assert quality.resolve_role(odd, ROLE_ALIASES["lag_24h"], "lag_24h", required=False) is None
    assert quality.resolve_role(odd, ROLE_ALIASES["lag_24h"], "lag_24h", loose=True) == "Vehicle Lag-24h"
    rows = spark.sql("SELECT 2024 AS year, 2 AS month, 29 AS day, timestamp_ntz'2025-01-01 23:00:00' AS hour_start_utc")
    by = lambda *a, **k: str(quality.with_local_date(*a, ROLE_ALIASES["time"], **k).first().role_date)
    assert (by(rows), by(rows.drop("hour_start_utc")), by(rows, stated="hour_start_utc")) == ("2025-01-01", "2024-02-29", "2025-01-01")
    for bad in (rows.drop("hour_start_utc", "day"), rows):
        with pytest.raises(ContractError):
            by(bad, **({"stated": "absent"} if bad is rows else {}))


def test_requests_see_history_only(spark):
    hist = stamped(spark, "u int, t string, n long", (1, "2024-01-01 00:00:00", 5), (1, "2024-01-01 01:00:00", 7), (1, "2024-01-01 02:00:00", 1000)).select("u", F.col("t").cast("timestamp_ntz").alias("h"), "n")
    ask = stamped(spark, "u int, t string", (1, "2024-01-01 02:00:00"), (9, "2024-01-01 02:00:00")).select("u", F.col("t").cast("timestamp_ntz").alias("h"))
    out = {r.u: r for r in feats.request_features(hist.filter("n < 1000"), ask, "u", "h", "n").collect()}
    assert (out[1].n_lag_1h, out[1].n_rolling_past_24h_mean, out[1].status) == (7, 6.0, "degraded")
    assert (out[9].status, out[9].feature_coverage) == ("unavailable", 0.0)


def test_contract_checks(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "k int, v int")
    report = {r.name: r.violations for r in quality.report(df, [quality.Expectation("null_v", F.col("v").isNull())], ["k"]).collect()}
    assert report == {"rows": 3, "null_v": 1, "duplicate_key_groups": 1}
    with pytest.raises(ContractError):
        quality.require_columns(df, ["x"])
    with pytest.raises(ContractError):
        quality.enforce(df.limit(0), [])
    with pytest.raises(ContractError):
        quality.require_same_keys(df, df, ["k"])
    assert quality.schema_hash(df) != quality.schema_hash(df.withColumnRenamed("v", "w"))


def test_a_year_is_excused_only_when_all_its_dates_are(spark):
    span = lambda a, b: quality.date_spine(spark.sql(f"SELECT DATE '{a}' AS a, DATE '{b}' AS b"), "a", "b")
    src = spark.createDataFrame([("s",)], "source string")
    seen = span("2023-01-01", "2023-12-31").withColumn("source", F.lit("s"))
    whole = quality.coverage_report(span("2023-01-01", "2024-12-31"), seen, span("2024-01-01", "2024-12-31"), src, seen)
    part = quality.coverage_report(span("2023-01-01", "2024-12-31"), seen, span("2024-01-02", "2024-12-31"), src, seen)
    assert not whole.first().partial and whole.first().missing_years == 0
    assert part.first().partial and part.first().missing_years == 1
    quality.refuse_partial(whole)
    with pytest.raises(ContractError):
        quality.refuse_partial(part)


def test_a_wrong_mark_shows_on_the_data(spark):
    hours = stamped(spark, "u int, t string, n long", *[(u, f"2024-01-0{d} {h:02d}:00:00", 5 * u + h + d) for u in (1, 2) for d in (1, 2, 3) for h in range(0, 24, 1 + u)])
    rows = hours.select("u", F.col("t").cast("timestamp_ntz").alias("h"), "n")

    def build(x):
        feed = x.groupBy("h").agg(F.sum("n").alias("feed"))  # of the same hour, not of the one before
        early = x.groupBy((F.col("h") + F.expr("INTERVAL 1 HOUR")).alias("h")).agg(F.sum("n").alias("early"))
        out = past_windows(x, ["u"], "h", "n").join(feed, "h").join(early, "h", "left")
        return quality.mark_known(out.withColumn("twice", F.col("n") * 2), ["feed", "early"])

    names = ["n_lag_1h", "n_rolling_past_24h_mean", "feed", "early", "twice"]
    moments = [1704186000000000, 1704240000000000]  # 2024-01-02 09:00 and 2024-01-03 00:00
    got = {r.name: r.changed for r in quality.leaks_on_data(build, rows, ["u"], "h", "n", names, moments).collect()}
    assert quality.leaking_features(build(rows), names) == ["twice"]  # the marks alone name one of the two
    assert got == {"n_lag_1h": 0, "n_rolling_past_24h_mean": 0, "feed": 3, "early": 0, "twice": 3}
