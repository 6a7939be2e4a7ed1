"""Canonical builders run over rows shaped like their sources, derived from the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.functions.timestamps import floor_hour, iso_text
from hourspark.operators import hourly
from hourspark.operators.quality import Expectation, conform, duplicate_keys, enforce, violations
from hourspark.plans import crowd, traffic
from hourspark.queries import Tables, query, rounded
from hourspark.queries.spatial import SUPPLIER_AT, spread_sql, suppliers
from hourspark.schemas import CROWD_DDL, CROWD_KEY, SLOT_COLUMNS, struct_of
from hourspark.session import cut

# Order dates moved by this many days span all three source windows.
SHIFT_DAYS = 8583

CROWD_SQL = f"""
d AS (SELECT *, (o_orderdate + INTERVAL {SHIFT_DAYS} DAY)::DATE AS local_date, (o_orderkey % 24)::TINYINT AS local_hour FROM orders),
s AS (SELECT *, CASE WHEN local_date <= DATE '2022-10-31' THEN 'com_pedestrian_counts_2009_2022'
   WHEN local_date <= DATE '2024-08-20' THEN 'com_pedestrian_counts_wayback_20250112' ELSE 'com_pedestrian_counts_current' END AS src,
   local_date::TIMESTAMP + to_hours(local_hour::INTEGER) AS wall FROM d),
z AS (SELECT *, ((wall - INTERVAL 11 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' = wall AS summer_ok,
   ((wall - INTERVAL 10 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' = wall AS standard_ok FROM s),
crowd AS (SELECT o_custkey || ':' || strftime(local_date, '%Y%m%d') || ':' || lpad(local_hour::VARCHAR, 2, '0') AS observation_key,
  src AS source_dataset_id, o_orderkey::VARCHAR AS source_record_id, o_orderkey + 1 AS source_row_number, o_custkey::INTEGER AS sensor_id,
  CASE WHEN o_orderstatus <> 'P' THEN 'Site ' || o_orderpriority END AS sensor_name, local_date, local_hour, wall AS observed_at_local,
  'Australia/Melbourne' AS timezone_name, summer_ok <> standard_ok AS utc_offset_known, CASE WHEN summer_ok <> standard_ok THEN summer_ok END AS is_dst,
  summer_ok AND standard_ok AS dst_ambiguous_local_time, NOT summer_ok AND NOT standard_ok AS dst_nonexistent_local_time,
  year(local_date)::SMALLINT AS year, month(local_date)::TINYINT AS month, day(local_date)::TINYINT AS day_of_month,
  (isodow(local_date) - 1)::TINYINT AS day_of_week, isodow(local_date) >= 6 AS is_weekend, floor(o_totalprice)::BIGINT AS pedestrian_flow,
  CASE WHEN src NOT LIKE '%2022' THEN (floor(o_totalprice)::BIGINT) // 2 END AS direction_1_count,
  CASE WHEN src NOT LIKE '%2022' THEN floor(o_totalprice)::BIGINT - (floor(o_totalprice)::BIGINT) // 2 END AS direction_2_count,
  CASE WHEN src NOT LIKE '%2022' THEN TRUE END AS direction_counts_valid,
  CASE WHEN src LIKE '%2022' THEN 'total_only' ELSE 'bidirectional_components' END AS direction_semantics,
  CASE WHEN src LIKE '%wayback%' THEN -37.5::DOUBLE END AS latitude, CASE WHEN src LIKE '%wayback%' THEN 144.25::DOUBLE END AS longitude,
  CASE WHEN src LIKE '%wayback%' THEN TRUE END AS coordinate_valid, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AS sensor_in_current_metadata,
  o_orderstatus = 'P' AS sensor_name_missing, src NOT LIKE '%wayback%' AS coordinate_missing, FALSE AS hour_was_reconstructed FROM z)"""


def crowd_rows(t: Tables) -> DataFrame:
    """All orders offered to each of the three snapshots; the source windows keep one copy of each."""
    day = F.date_add(F.to_date("o_orderdate"), SHIFT_DAYS)
    hour, flow = F.pmod("o_orderkey", F.lit(24)), F.floor("o_totalprice")
    name = F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.concat(F.lit(" Site "), F.col("o_orderpriority")))
    text = lambda c: c.cast("string")
    o = t.orders
    old = o.select(
        text(F.col("o_orderkey")).alias("ID"), text(day).alias("Date_Time"), text(F.year(day)).alias("Year"), F.date_format(day, "MMMM").alias("Month"),
        text(F.dayofmonth(day)).alias("Mdate"), F.date_format(day, "EEEE").alias("Day"), text(hour).alias("Time"), text(F.col("o_custkey")).alias("Sensor_ID"),
        name.alias("Sensor_Name"), text(flow).alias("Hourly_Counts"), (F.col("o_orderkey") + 1).alias("row_number"),
    )
    half = F.floor(flow / 2)
    new = lambda where: o.select(
        text(F.col("o_orderkey")).alias("id"), text(F.col("o_custkey")).alias("location_id"), text(day).alias("sensing_date"), text(hour).alias("hourday"),
        text(half).alias("direction_1"), text(flow - half).alias("direction_2"), text(flow).alias("pedestriancount"), name.alias("sensor_name"),
        where.alias("location"), (F.col("o_orderkey") + 1).alias("row_number"),
    )
    sensors = t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("location_id"))
    return crowd.canonical([
        crowd.historical(old), crowd.modern(new(F.lit("-37.5, 144.25")), crowd.ARCHIVED_ID),
        crowd.modern(new(F.lit(None).cast("binary")), crowd.CURRENT_ID),
    ], sensors)


@query(f"WITH {CROWD_SQL} SELECT * FROM crowd")
def crowd_canonical(t: Tables) -> DataFrame:
    return crowd_rows(t)


@query(f"""WITH {CROWD_SQL} SELECT source_dataset_id, count(*) AS selected_rows, min(local_date) AS min_date, max(local_date) AS max_date, count(DISTINCT local_date) AS dates,
  count(*) FILTER (WHERE pedestrian_flow = 0) AS zero_flow_rows, count(*) FILTER (WHERE NOT direction_counts_valid) AS invalid_direction_rows,
  count(*) FILTER (WHERE sensor_name_missing) AS missing_sensor_name_rows, count(*) FILTER (WHERE coordinate_missing) AS missing_coordinate_rows,
  count(*) FILTER (WHERE NOT coordinate_valid) AS invalid_coordinate_rows, count(*) FILTER (WHERE NOT sensor_in_current_metadata) AS missing_current_metadata_rows,
  count(*) FILTER (WHERE dst_ambiguous_local_time) AS dst_ambiguous_rows, count(*) FILTER (WHERE dst_nonexistent_local_time) AS dst_nonexistent_rows,
  count(*) FILTER (WHERE hour_was_reconstructed) AS reconstructed_hour_rows FROM crowd GROUP BY 1""")
def source_metrics(t: Tables) -> DataFrame:
    return crowd.source_metrics(crowd_rows(t))


@query("""SELECT CASE WHEN o_orderdate::DATE <= DATE '1996-12-31' THEN 'a' WHEN o_orderdate::DATE <= DATE '1999-06-30' THEN 'b' ELSE 'c' END AS source_dataset_id,
  o_orderkey::VARCHAR AS source_record_id, o_custkey::INTEGER AS sensor_id, o_orderdate::DATE AS local_date, floor(o_totalprice)::BIGINT AS pedestrian_flow FROM orders""")
def source_windows_union(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    windows = {"a": (None, dt.date(1996, 12, 31)), "b": (dt.date(1997, 1, 1), dt.date(1999, 6, 30)), "c": (dt.date(1999, 7, 1), None)}
    parts = [
        conform(t.orders.filter(crowd.source_window(day, *w)).select(
            F.lit(s).alias("source_dataset_id"), F.col("o_orderkey").alias("source_record_id"), F.col("o_custkey").alias("sensor_id"),
            day.alias("local_date"), F.floor("o_totalprice").alias("pedestrian_flow"),
        ), struct_of(CROWD_DDL))
        for s, w in windows.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("source_dataset_id", "source_record_id", "sensor_id", "local_date", "pedestrian_flow")


@query("""WITH c AS (SELECT o_custkey AS unit, count(*) AS row_count, min(o_orderdate::DATE) AS first_date, max(o_orderdate::DATE) AS last_date,
    count(*) FILTER (WHERE o_orderstatus = 'F') AS filled_rows, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_rows,
    count(DISTINCT o_orderpriority) AS distinct_names, string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) AS names FROM orders GROUP BY 1)
  SELECT c.*, c_name AS metadata_c_name, c_custkey IS NOT NULL AS current_metadata_present FROM c LEFT JOIN customer ON c_custkey = unit""")
def unit_coverage(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_custkey").alias("unit"), "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    metadata = t.customer.select(F.col("c_custkey").alias("unit"), "c_name")
    return crowd.unit_coverage(orders, "unit", "o_orderstatus", {"filled": "F", "open": "O"}, "day", "o_orderpriority", metadata)


@query(f"WITH {CROWD_SQL} SELECT sensor_id, local_date, local_hour, count(*) AS copies FROM crowd GROUP BY ALL HAVING count(*) > 1")
def crowd_duplicate_keys(t: Tables) -> DataFrame:
    return duplicate_keys(crowd_rows(t), CROWD_KEY)


# Five-minute class counts --------------------------------------------------------------------------

CLASSES = {"click": "Car", "purchase": "truck", "view": "cyclist", "signup": "pedestrian", "error": "escooter"}
COUNTLINE_SQL = """
raw AS (SELECT user_id::VARCHAR AS site, 'line ' || user_id % 7 AS name, time_bucket(INTERVAL 5 MINUTE, ts) AS wall, event_type IN ('click', 'purchase') AS motor,
  event_type, floor(value)::BIGINT AS cnt, -37.8 - (event_id % 3) / 1000.0::DOUBLE AS lat FROM events),
utc AS (SELECT *, wall - INTERVAL 11 HOUR AS from_utc FROM raw),
spot AS (SELECT site, name, date_trunc('hour', from_utc) AS hour, lat, count(*) AS c FROM utc GROUP BY ALL),
best AS (SELECT site, name, hour, arg_max(lat, c * 1000 + lat) AS lat, count(*) > 1 AS drift FROM spot GROUP BY ALL),
hours AS (SELECT site, name, date_trunc('hour', from_utc) AS hour, sum(CASE WHEN motor THEN cnt END)::BIGINT AS motor_count, count(*) FILTER (WHERE motor) AS motor_rows,
  count(*) FILTER (WHERE NOT motor) AS other_rows, count(*) AS rows, count(DISTINCT from_utc) AS stamps, min(from_utc) AS first_utc, max(from_utc) + INTERVAL 5 MINUTE AS last_utc FROM utc GROUP BY ALL)"""


def countline_feed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(raw rows, reviewed lines) shaped like the five-minute feed, event times read as wall times."""
    slot = F.concat(F.substring(iso_text(F.col("ts")), 1, 14), F.lpad((F.floor(F.minute("ts") / 5) * 5).cast("string"), 2, "0"), F.lit(":00"))
    end = iso_text(F.to_timestamp_ntz(slot) + F.expr("interval 5 minutes"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), F.col("event_type"))
    name = F.concat(F.lit("line "), F.pmod("user_id", F.lit(7)).cast("string"))
    raw = t.events.select(
        F.concat(F.col("user_id").cast("string"), F.lit(".0")).alias("countLocationId"), name.alias("countlineName"), F.lit("N").alias("countlineDirection"),
        (-37.8 - F.pmod("event_id", F.lit(3)) / F.lit(1000.0)).cast("string").alias("CountLocationLat"), F.lit("144.96").alias("CountLocationLong"),
        F.concat(slot, F.lit("Z")).alias("from"), F.concat(end, F.lit("Z")).alias("to"), label.alias("class"),
        F.floor("value").cast("string").alias("count"), F.year("ts").cast("string").alias("year"), F.quarter("ts").cast("string").alias("quarter"),
        F.lit("events").alias("source_dataset_id"), F.lit("events.csv").alias("member"),
    )
    lines = t.events.select("user_id").distinct().select(
        F.col("user_id").cast("string").alias("count_location_id"), name.alias("countline_name"), F.lit("road").alias("channel_type"),
        F.lit("Yes").alias("traffic_eligible"), F.lit(" Approved ").alias("review_status"), F.lit("").alias("notes"),
    )
    return raw, traffic.registry(lines)


@query(f"""WITH {COUNTLINE_SQL} SELECT 'ta:' || site AS observation_unit_id, name AS countline_name, hour AS hour_start_utc, hour + INTERVAL 11 HOUR AS local_timestamp,
  CASE WHEN motor_rows = 0 THEN 0 ELSE motor_count END AS vehicle_count, CASE WHEN motor_rows = 0 THEN 'derived_zero' ELSE 'observed' END AS label_quality,
  concat_ws(';', CASE WHEN drift THEN 'coordinate_drift' END, CASE WHEN motor_rows = 0 THEN 'derived_zero' END) AS quality_flag, motor_rows AS ta_motor_class_rows,
  other_rows AS ta_non_motor_class_rows, rows AS source_row_count, stamps AS source_timestamp_count, first_utc AS source_timestamp_first_utc, last_utc AS source_timestamp_last_utc,
  660 AS source_timezone_offset_minutes, round(lat, 7) AS latitude, drift AS coordinate_drift_flag FROM hours JOIN best USING (site, name, hour)""")
def countline_hours(t: Tables) -> DataFrame:
    raw, lines = countline_feed(t)
    table = traffic.canonical([traffic.countline_hours(traffic.countline_rows(raw, lines))])
    return table.select(
        "observation_unit_id", "countline_name", "hour_start_utc", "local_timestamp", "vehicle_count", "label_quality", "quality_flag", "ta_motor_class_rows",
        "ta_non_motor_class_rows", "source_row_count", "source_timestamp_count", "source_timestamp_first_utc", "source_timestamp_last_utc",
        "source_timezone_offset_minutes", F.round("latitude", 7).alias("latitude"), "coordinate_drift_flag",
    )


@query("""SELECT user_id, date_trunc('hour', ts) AS hour, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS motor_rows,
  CASE WHEN count(*) FILTER (WHERE event_type IN ('click', 'purchase')) = 0 THEN 0 ELSE round(sum(CASE WHEN event_type IN ('click', 'purchase') THEN value END), 4) END::DOUBLE AS vehicle_count,
  count(*) FILTER (WHERE event_type IN ('click', 'purchase')) = 0 AS derived_zero FROM events GROUP BY 1, 2""")
def derived_zero(t: Tables) -> DataFrame:
    motor = F.col("event_type").isin("click", "purchase")
    hours = t.events.groupBy("user_id", floor_hour(F.col("ts")).alias("hour")).agg(
        F.count_if(motor).alias("motor_rows"), F.count_if(~motor).alias("other_rows"), F.sum(F.when(motor, F.col("value"))).alias("total"),
    )
    zero = (F.col("motor_rows") == 0) & (F.col("other_rows") > 0)
    return hours.select("user_id", "hour", "motor_rows", F.when(zero, 0.0).otherwise(F.round("total", 4)).alias("vehicle_count"), zero.alias("derived_zero"))


@query("""WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS c FROM lineitem GROUP BY ALL)
  SELECT l_partkey, arg_max(l_suppkey, c * 1000000000 + l_suppkey) AS usual_supplier, count(*) > 1 AS usual_supplier_drift FROM c GROUP BY 1""")
def mode_value(t: Tables) -> DataFrame:
    return hourly.mode_value(t.lineitem, ["l_partkey"], F.col("l_suppkey"), "usual_supplier")


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS only_flag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS only_status FROM lineitem GROUP BY 1")
def single_or_null(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(
        hourly.single_or_null(F.col("l_returnflag")).alias("only_flag"), hourly.single_or_null(F.col("l_linestatus")).alias("only_status"),
    )


# Quarter-hour detector days ------------------------------------------------------------------------

SLOTS = [f"s{i}" for i in range(8)]
DAYS_SQL = """
days AS (SELECT l_suppkey AS site, l_shipdate::DATE AS day, l_orderkey AS detector, l_partkey % 2 AS odd, l_quantity::BIGINT AS s0, l_linenumber::BIGINT AS s1,
  CASE WHEN l_returnflag = 'R' THEN -1 ELSE 4 END::BIGINT AS s2, CASE WHEN l_tax > 0.06 THEN -5 ELSE 1 END::BIGINT AS s3,
  CASE WHEN l_linestatus = 'O' THEN -1 ELSE 2 END::BIGINT AS s4, CASE WHEN l_linestatus = 'O' THEN -1 ELSE 3 END::BIGINT AS s5,
  CASE WHEN l_linestatus = 'O' THEN -30 ELSE 4 END::BIGINT AS s6, CASE WHEN l_linestatus = 'O' THEN -1 ELSE 0 END::BIGINT AS s7,
  CASE WHEN l_linenumber = 7 THEN 95 ELSE 96 END::BIGINT AS records, l_extendedprice AS volume, CASE WHEN l_discount > 0.09 THEN TRUE WHEN l_discount < 0.005 THEN NULL ELSE FALSE END AS alarm FROM lineitem),
long AS (SELECT *, 0 AS hour, [s0, s1, s2, s3] AS r FROM days UNION ALL SELECT *, 1 AS hour, [s4, s5, s6, s7] AS r FROM days)"""


def detector_days(t: Tables) -> DataFrame:
    flag = lambda cond, a, b: F.when(cond, a).otherwise(b).cast("bigint")
    off = F.col("l_linestatus") == "O"
    return t.lineitem.select(
        F.lit("lineitem").alias("source_dataset_id"), F.lit("lineitem.csv").alias("member"), F.col("l_suppkey").alias("scats_site"),
        F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("detector"),
        F.col("l_quantity").cast("bigint").alias("s0"), F.col("l_linenumber").cast("bigint").alias("s1"),
        flag(F.col("l_returnflag") == "R", -1, 4).alias("s2"), flag(F.col("l_tax") > 0.06, -5, 1).alias("s3"),
        flag(off, -1, 2).alias("s4"), flag(off, -1, 3).alias("s5"), flag(off, -30, 4).alias("s6"), flag(off, -1, 0).alias("s7"),
        flag(F.col("l_linenumber") == 7, 95, 96).alias("records"), F.col("l_extendedprice").alias("volume"),
        F.when(F.col("l_discount") > 0.09, True).when(F.col("l_discount") < 0.005, F.lit(None)).otherwise(False).alias("alarm"),
    )


@query(f"""WITH {DAYS_SQL} SELECT site, day, hour, sum(list_sum(list_filter(r, lambda x: x >= 0)))::BIGINT AS vehicle_count,
  sum(4 - len(list_filter(r, lambda x: x >= 0)))::BIGINT AS missing_slots, count(DISTINCT detector) AS detectors, count(*) AS detector_rows, min(records) AS records_min, max(records) AS records_max,
  round(sum(volume), 4) AS volume_sum, count(*) FILTER (WHERE alarm) AS alarms,
  sum(4 - len(list_filter(r, lambda x: x >= 0))) > 0 OR count(*) FILTER (WHERE records <> 96) > 0 AS partial,
  CASE WHEN count(*) FILTER (WHERE alarm) > 0 THEN TRUE WHEN count(*) FILTER (WHERE alarm IS NULL) = 0 THEN FALSE END AS alarm
  FROM long GROUP BY 1, 2, 3 HAVING sum(list_sum(list_filter(r, lambda x: x >= 0))) IS NOT NULL""")
def slot_rollup(t: Tables) -> DataFrame:
    out = traffic.site_hours(detector_days(t), hours_per_day=2, slots=SLOTS)
    return rounded(out.select(
        F.col("scats_site").alias("site"), "day", "hour", "vehicle_count", "missing_slots", "detectors", "detector_rows", "records_min", "records_max", "volume_sum", "alarms", "partial", "alarm",
    ), "volume_sum", digits=4)


@query(f"""WITH {DAYS_SQL}, v AS (SELECT unnest([s0, s1, s2, s3, s4, s5, s6, s7]) AS x FROM days), f AS (SELECT x, count(*) AS n FROM v WHERE x < 0 GROUP BY 1)
  SELECT sum(n)::BIGINT AS negative, sum(CASE WHEN x = -1 THEN n END)::BIGINT AS standard, sum(CASE WHEN x < -1 THEN n END)::BIGINT AS nonstandard,
  string_agg(x || '=' || n, ',' ORDER BY x::VARCHAR) AS frequency FROM f""")
def negative_readings(t: Tables) -> DataFrame:
    out = traffic.negative_readings(detector_days(t), SLOTS)
    shown = F.array_join(F.transform(F.map_entries("frequency"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.withColumn("frequency", shown)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([0, 1, 2, 3]) AS slot, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS reading FROM lineitem)
  SELECT l_orderkey, l_linenumber, slot, count(*) AS rows, round(max(reading), 6) AS reading FROM l GROUP BY 1, 2, 3""")
def wide_to_long(t: Tables) -> DataFrame:
    long = hourly.slots_long(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(long.groupBy("l_orderkey", "l_linenumber", "slot").agg(F.count(F.lit(1)).alias("rows"), F.max("reading").alias("reading")), "reading")


@query(f"""WITH {DAYS_SQL}, v AS (SELECT site, unnest([s0, s1, s2, s3, s4, s5, s6, s7]) AS x FROM days JOIN supplier ON s_suppkey = site WHERE s_acctbal >= 0)
  SELECT site, count(*) AS rows, count(*) FILTER (WHERE x >= 0) AS readings, sum(x)::BIGINT AS total FROM v GROUP BY 1""")
def early_site_filter(t: Tables) -> DataFrame:
    """Ineligible sites are dropped by a semi join before the slots are expanded."""
    eligible = t.supplier.filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("scats_site"))
    kept = detector_days(t).join(eligible, "scats_site", "left_semi")
    long = hourly.slots_long(kept, ["scats_site"], SLOTS)
    return long.groupBy(F.col("scats_site").alias("site")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reading") >= 0).alias("readings"), F.sum("reading").cast("bigint").alias("total")
    )


# The whole vehicle table ---------------------------------------------------------------------------

_WEST, _SOUTH, _EAST, _NORTH = traffic.CITY_BOX


def detector_feed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(raw days of 96 slots as text, signal places): shipped quantities of a supplier's odd and even lines."""
    days = t.lineitem.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day"), F.pmod("l_linenumber", F.lit(2)).alias("line")).agg(
        F.sum("l_quantity").cast("bigint").alias("q"), F.count(F.lit(1)).alias("c")
    )
    slot = lambda i: (F.col("q") + F.lit(i) * (F.col("l_suppkey") % 7 + 1)) % 23 - 1
    alarm = F.when(F.col("q") % 5 == 0, "1").when(F.col("q") % 11 == 0, "").otherwise("0")
    raw = days.select(
        F.concat(F.col("l_suppkey").cast("string"), F.lit(".0")).alias("NB_SCATS_SITE"), F.col("day").cast("string").alias("QT_INTERVAL_COUNT"),
        F.col("line").cast("string").alias("NB_DETECTOR"), F.lit("R").alias("NM_REGION"), F.when(F.col("c") > 1, "95").otherwise("96").alias("CT_RECORDS"),
        F.col("q").cast("string").alias("QT_VOLUME_24HOUR"), alarm.alias("CT_ALARM_24HOUR"), *[slot(i).cast("string").alias(c) for i, c in enumerate(SLOT_COLUMNS)],
        F.lit("vic_scats").alias("source_dataset_id"), F.lit("days.csv").alias("member"),
    )
    places = suppliers(t).select(
        F.col("site_id").cast("string").alias("SITE_NO"), F.lit("s").alias("SITE_NAME"), F.lit("x").alias("TYPE"), F.lit("m").alias("MUNICIPALITY"),
        F.col("lat").cast("string").alias("LATITUDE"), F.col("lon").cast("string").alias("LONGITUDE"),
    )
    return raw, places


@query(f"""WITH {COUNTLINE_SQL},
  s AS (SELECT s_suppkey AS site, round({spread_sql("s_suppkey", *SUPPLIER_AT["lon"])}, 7) AS lon, round({spread_sql("s_suppkey", *SUPPLIER_AT["lat"])}, 7) AS lat FROM supplier),
  d AS (SELECT l_suppkey AS site, l_shipdate::DATE AS day, l_linenumber % 2 AS line, sum(l_quantity)::BIGINT AS q, count(*) AS c FROM lineitem JOIN s ON s.site = l_suppkey
    WHERE lon BETWEEN {_WEST} AND {_EAST} AND lat BETWEEN {_SOUTH} AND {_NORTH} GROUP BY 1, 2, 3),
  h AS (SELECT *, unnest(range(96)) AS slot FROM d), r AS (SELECT *, slot // 4 AS hour, (q + slot * (site % 7 + 1)) % 23 - 1 AS x FROM h),
  a AS (SELECT site, day, hour, sum(x) FILTER (WHERE x >= 0)::BIGINT AS v, count(*) FILTER (WHERE x < 0) AS missing, bool_or(c > 1) AS odd, bool_or(q % 5 = 0) AS alarm, bool_or(q % 5 <> 0 AND q % 11 = 0) AS unknown FROM r GROUP BY 1, 2, 3),
  u AS (SELECT 'scats' AS label_source, 'scats:' || site AS observation_unit_id, day + to_hours(hour::BIGINT) - INTERVAL 10 HOUR AS at_utc, v, missing > 0 OR odd AS partial, alarm, missing, NOT alarm AND unknown AS alarm_unknown, FALSE AS derived FROM a WHERE v IS NOT NULL
    UNION ALL SELECT 'transport_activity', 'ta:' || site, hour, CASE WHEN motor_rows = 0 THEN 0 ELSE motor_count END, FALSE, FALSE, 0, FALSE, motor_rows = 0 FROM hours)
  SELECT label_source, observation_unit_id, count(*) AS hours, sum(v)::BIGINT AS vehicles, round(sum(ln(v + 1.0::DOUBLE)), 4) AS log_vehicles, count(*) FILTER (WHERE partial) AS partial_hours, count(*) FILTER (WHERE alarm) AS alarm_hours,
    count(*) FILTER (WHERE alarm_unknown) AS unknown_alarms, sum(missing)::BIGINT AS missing_intervals, count(*) FILTER (WHERE derived) AS derived_hours, min(at_utc) AS first_hour, max(at_utc) AS last_hour FROM u GROUP BY 1, 2""")
def traffic_canonical(t: Tables) -> DataFrame:
    """The whole vehicle build: 96-slot detector days and five-minute countlines parsed, united, checked, and summed by unit."""
    raw, lines = countline_feed(t)
    feed, places = detector_feed(t)
    detectors = traffic.detector_hours(traffic.detector_days(feed), traffic.signals(places))
    table = cut(traffic.canonical([detectors, traffic.countline_hours(traffic.countline_rows(raw, lines))]))
    checked = enforce(traffic.validated(table), traffic.source_rules(dt.date(1990, 1, 1), dt.date(2030, 12, 31)))
    counted = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rounded(checked.groupBy("label_source", "observation_unit_id").agg(
        F.count(F.lit(1)).alias("hours"), F.sum("vehicle_count").alias("vehicles"), F.sum("log1p_vehicle_count").alias("log_vehicles"),
        counted(F.col("quality_partial_flag")).alias("partial_hours"), counted(F.col("quality_alarm_flag")).alias("alarm_hours"),
        F.count_if(F.col("quality_alarm_flag").isNull()).alias("unknown_alarms"), F.sum("quality_missing_interval_count").alias("missing_intervals"),
        counted(F.col("ta_derived_zero")).alias("derived_hours"), F.min("hour_start_utc").alias("first_hour"), F.max("hour_start_utc").alias("last_hour"),
    ), "log_vehicles", digits=4)


@query("""SELECT o_orderpriority AS source, count(*) AS rows, count(*) FILTER (WHERE o_orderdate::DATE <> DATE '1998-01-01' AND o_orderstatus IS DISTINCT FROM 'F') AS source_semantics,
  count(*) FILTER (WHERE o_orderdate::DATE < DATE '1996-01-01' OR o_orderdate::DATE > DATE '2000-12-31') AS out_of_bounds FROM orders GROUP BY 1""")
def release_rules(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    rules = [
        Expectation("source_semantics", (day != F.lit(dt.date(1998, 1, 1))) & ~F.col("o_orderstatus").eqNullSafe("F")),
        Expectation("out_of_bounds", ~day.between(F.lit(dt.date(1996, 1, 1)), F.lit(dt.date(2000, 12, 31)))),
    ]
    return violations(t.orders.withColumnRenamed("o_orderpriority", "source"), rules, ["source"])


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'scats' ELSE 'transport_activity' END AS label_source, year(o_orderdate) AS source_year, count(*) AS rows FROM orders
  WHERE o_orderdate::DATE BETWEEN DATE '1996-03-01' AND DATE '2000-08-31' GROUP BY 1, 2""")
def release_selection(t: Tables) -> DataFrame:
    """Date-bounded selection; a detector row is bounded by its source date, another row by its local date."""
    detector = F.col("o_orderstatus") == "F"
    day = F.to_date("o_orderdate")
    table = t.orders.select(
        F.when(detector, "scats").otherwise("transport_activity").alias("label_source"), F.concat(F.lit("vic_"), (F.year(day) + 5).cast("string")).alias("source_dataset_id"),
        F.when(detector, day).alias("scats_source_date_local"), F.when(detector, F.date_add(day, 4000)).otherwise(day).alias("local_date"),
    )
    kept = traffic.release(table, dt.date(1996, 3, 1), dt.date(2000, 8, 31), [2099])
    return kept.groupBy("label_source", (traffic.source_year(F.col("source_dataset_id")) - 5).cast("bigint").alias("source_year")).agg(F.count(F.lit(1)).alias("rows"))
